"""Policies, regulation packs, jobs and the plans built from them."""
