"""Rule files beyond what a rule set may hold."""

import json

import pytest

from quillon.sources import rules


def test_no_rule_file_vanishes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rules, "RULES_MAX", 3)
    some = rules.default_rules()[:4]
    (tmp_path / "0.json").write_text("[]")
    for i, rule in enumerate(some[:3], 1):
        (tmp_path / f"{i}.json").write_text(json.dumps(rule))
    got = rules.load_rules(spark, str(tmp_path)).collect()
    assert [r.rule_id for r in got] == [r["rule_id"] for r in some[:3] if r["active"]]
    (tmp_path / "4.json").write_text(json.dumps(some[3]))
    with pytest.raises(rules.RuleError, match="at most"):
        rules.load_rules(spark, str(tmp_path))
