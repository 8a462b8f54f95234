"""All queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from brindle.plans import forms, jobs


def queries() -> dict:
    return forms.QUERIES | jobs.QUERIES


def oracle_sql() -> dict:
    return forms.ORACLES | jobs.ORACLES
