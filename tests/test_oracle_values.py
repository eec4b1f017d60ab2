"""The oracle's own values and the engine's constants: both are stated by hand, and must agree."""

from docvet.functions import fixed, rules
from docvet.plans import oracle_values as V
from docvet.plans import sqlgen as S


def test_constants_agree():
    for name in ("ALLOWED_VALUES", "SCOPE_BUCKETS", "FILL_FIELDS", "UNFILLED_TOKENS", "CONFIDENCE_CAP", "PENALTY_CAP", "DOC_INDICATORS", "DOC_BLOCKED"):
        assert getattr(V, name) == getattr(fixed, name), name


def test_a_changed_pack_no_longer_changes_its_oracle(monkeypatch):
    before = S.classify("x", rules.AUTH)
    monkeypatch.setattr(fixed, "DOC_BLOCKED", ())
    assert S.classify("x", rules.AUTH) == before
    assert "medium.com" in S.official_url("url")
    assert {n for n in dir(rules) if isinstance(getattr(rules, n), rules.RulePack)} == set(V.RULES)
