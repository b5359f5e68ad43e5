"""Policies, jobs and regulation packs.

Documents of a mode are masked by a policy table (target, type) -> strategy. Whatever a
policy does not name is suppressed. Under `training`, strategies that make the same
surrogate again in another document are refused when a policy is loaded, when a plan is
built, and in the plan itself.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from pathlib import Path

TARGETS = ("training", "rag")
STRATEGIES = ("placeholder_indexed", "generalize", "date_shift", "hmac_pseudonym", "fpe", "suppress", "keep")
LINKABLE = frozenset({"hmac_pseudonym", "fpe"})
# What an action weighs when packs are composed.
SEVERITY = {"keep": 0, "generalize": 1, "date_shift": 1, "placeholder_indexed": 2, "hmac_tokenize": 2, "hmac_pseudonym": 2, "fpe": 2, "hash_irreversible": 3, "suppress": 4}
BELOW_SEVERITY = {"keep": 0, "review": 1, "mask_anyway": 2}
CATEGORIES = ("default", "baseline", "privacy", "sector", "")


class PolicyViolation(ValueError):
    """A policy, pack or job that breaks a rule of its target."""


@dataclass(frozen=True)
class Entry:
    strategy: str
    indexed: bool = True
    token: str | None = None
    params: dict = field(default_factory=dict)


@dataclass
class Policy:
    entries: dict[tuple[str, str], Entry]
    version: str = "0"

    def lookup(self, target: str, entity_type: str) -> Entry:
        return self.entries.get((target, entity_type.upper()), Entry("suppress"))

    def of(self, target: str) -> dict[str, Entry]:
        return {kind: e for (t, kind), e in self.entries.items() if t == target}


@dataclass
class Job:
    job_id: str = "job"
    target: str = "training"
    tenant_id: str = "default"
    confidence_threshold: float = 0.5
    type_thresholds: dict[str, float] = field(default_factory=dict)
    strategy_overrides: dict[str, str] = field(default_factory=dict)
    salt_scope: str = "tenant"
    corpus_id: str | None = None
    reversible: bool = False
    pseudonym_len: int = 8
    policy_version: str = "0"

    def __post_init__(self) -> None:
        if self.target not in TARGETS:
            raise PolicyViolation(f"unknown target {self.target!r}")
        if self.salt_scope not in ("tenant", "corpus", "run"):
            raise PolicyViolation(f"unknown salt scope {self.salt_scope!r}")
        self.type_thresholds = {k.upper(): float(v) for k, v in self.type_thresholds.items()}
        self.strategy_overrides = {k.upper(): v for k, v in self.strategy_overrides.items()}
        for kind, strategy in self.strategy_overrides.items():
            if strategy not in STRATEGIES:
                raise PolicyViolation(f"unknown strategy {strategy!r} for {kind}")
            if self.target == "training" and strategy in LINKABLE:
                raise PolicyViolation(f"{strategy} is linkable and not for training ({kind})")

    def threshold(self, entity_type: str) -> float:
        return self.type_thresholds.get(entity_type.upper(), self.confidence_threshold)


def job_of(message: dict) -> Job:
    """A job from a message's dict; its target's key there is downstream_target."""
    known = {k: v for k, v in message.items() if k in Job.__dataclass_fields__ and k != "target"}
    job = Job(target=message["downstream_target"], **known)
    if not 0 <= job.confidence_threshold <= 1 or not 6 <= job.pseudonym_len <= 32:
        raise PolicyViolation("a job's confidence threshold is from 0 to 1, its pseudonyms' length from 6 to 32")
    return job


def build_policy(data: dict) -> Policy:
    """A policy from a dict {version, default_strategy, policies: {target: {type: entry}}}."""
    if unknown := set(data) - {"version", "default_strategy", "policies"}:
        raise PolicyViolation(f"unknown keys {sorted(unknown)}")
    if "policies" not in data:
        raise PolicyViolation("a policy needs policies")
    if data.get("default_strategy", "suppress") != "suppress":
        raise PolicyViolation("the default strategy is suppress")
    entries = {}
    for target, kinds in data["policies"].items():
        if target not in TARGETS:
            raise PolicyViolation(f"unknown target {target!r}")
        for kind, value in (kinds or {}).items():
            value = {"strategy": value} if isinstance(value, str) else dict(value)
            if unknown := set(value) - {"strategy", "indexed", "token", "params"}:
                raise PolicyViolation(f"unknown keys {sorted(unknown)} for {kind}")
            if value.get("strategy") not in STRATEGIES:
                raise PolicyViolation(f"unknown strategy {value.get('strategy')!r} for {kind}")
            if target == "training" and value["strategy"] in LINKABLE:
                raise PolicyViolation(f"{value['strategy']} is linkable and not for training ({kind})")
            entries[target, kind.upper()] = Entry(value["strategy"], bool(value.get("indexed", True)), value.get("token"), value.get("params") or {})
    return Policy(entries, str(data.get("version", "0")))


def load_policy(path: str | Path) -> Policy:
    import yaml

    return build_policy(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def default_policy() -> Policy:
    """The policy that ships; its values decide what masked corpora look like."""
    bare = lambda token=None: {"strategy": "placeholder_indexed", "indexed": False} | ({"token": token} if token else {})
    numbered = lambda token: {"strategy": "placeholder_indexed", "token": token}
    training = {"PERSON": numbered("NAME"), "ORG": numbered("ORG"), "ORGANIZATION": numbered("ORG"), "LOCATION": numbered("LOC"), "ADDRESS": numbered("ADDR")}
    training |= {kind: bare(kind) for kind in ("EMAIL", "PHONE", "URL", "IP")}
    training |= {kind: bare() for kind in ("MEDICATION", "DIAGNOSIS", "PROCEDURE")}
    training |= {"DATE": "date_shift", "DOB": "generalize", "ZIP": "generalize", "PINCODE": "generalize", "AGE": {"strategy": "generalize", "params": {"bracket_5y": True}}}
    training |= dict.fromkeys(("CREDIT_CARD", "SSN", "AADHAAR", "PAN", "PASSPORT", "ACCOUNT_NUMBER", "MRN"), "suppress")
    rag = dict.fromkeys(("PERSON", "ORG", "ORGANIZATION", "LOCATION", "ADDRESS", "EMAIL", "IP", "PAN", "PASSPORT"), "hmac_pseudonym")
    rag |= dict.fromkeys(("CREDIT_CARD", "PHONE", "SSN", "AADHAAR", "ACCOUNT_NUMBER", "MRN"), "fpe")
    rag |= dict.fromkeys(("DATE", "ZIP", "PINCODE", "AGE", "MEDICATION", "DIAGNOSIS", "PROCEDURE"), "keep")
    rag |= {"URL": "suppress", "DOB": "generalize"}
    return build_policy({"version": "1.0", "policies": {"training": training, "rag": rag}})


# --- regulation packs


@dataclass(frozen=True)
class Rule:
    entity: str
    action: str
    min_confidence: float = 0.0


@dataclass
class Pack:
    regulation: str
    version: str
    rules: list[Rule]
    below_threshold: str = "keep"
    jurisdiction: str = ""
    category: str = ""
    description: str = ""
    sha256: str = ""

    def rule_for(self, entity: str) -> Rule | None:
        return next((r for r in self.rules if r.entity == entity.upper()), None)

    def targets(self) -> set[str]:
        return {"rag"} if any(r.action in LINKABLE for r in self.rules) else set(TARGETS)


def build_pack(data: dict, sha256: str = "") -> Pack:
    known = {"regulation", "version", "description", "jurisdiction", "category", "default_action", "below_threshold", "rules", "sha256"}
    if unknown := set(data) - known:
        raise PolicyViolation(f"unknown keys {sorted(unknown)}")
    if missing := {"regulation", "version", "rules"} - set(data):
        raise PolicyViolation(f"missing keys {sorted(missing)}")
    if data.get("default_action", "suppress") != "suppress":
        raise PolicyViolation("the default action is suppress")
    if data.get("below_threshold", "keep") not in BELOW_SEVERITY or data.get("category", "") not in CATEGORIES:
        raise PolicyViolation("unknown below_threshold or category")
    rules = []
    for r in data["rules"]:
        if unknown := set(r) - {"entity", "min_confidence", "action", "params", "render", "condition"}:
            raise PolicyViolation(f"unknown keys {sorted(unknown)}")
        entity, least = str(r.get("entity", "")).strip().upper(), float(r.get("min_confidence", 0.0))
        if not entity or r.get("action") not in SEVERITY or not 0 <= least <= 1:
            raise PolicyViolation(f"not a rule: {r}")
        if any(x.entity == entity for x in rules):
            raise PolicyViolation(f"two rules for {entity}")
        rules.append(Rule(entity, r["action"], least))
    return Pack(str(data["regulation"]), str(data["version"]), rules, data.get("below_threshold", "keep"), data.get("jurisdiction", ""), data.get("category", ""), data.get("description", ""), sha256)


def load_pack(path: str | Path) -> Pack:
    import yaml

    raw = Path(path).read_bytes()
    return build_pack(yaml.safe_load(raw) or {}, hashlib.sha256(raw).hexdigest())


def load_packs(folder: str | Path, names: list[str]) -> list[Pack]:
    there = {p.stem: p for p in sorted(Path(folder).glob("*.yaml"))}
    for name in names:
        if name not in there:
            raise FileNotFoundError(f"no pack {name!r}; there are {sorted(there)}")
    return [load_pack(there[name]) for name in names]


def strategy_of(action: str, target: str) -> str:
    """The strategy that carries out a pack's action under a target."""
    if action == "hmac_tokenize":
        return "placeholder_indexed" if target == "training" else "hmac_pseudonym"
    if action == "hash_irreversible":
        return "suppress"
    if target == "training" and action in LINKABLE:
        raise PolicyViolation(f"action {action} is linkable and not for training")
    return action
