"""A stage runs one Python step: two would keep two Python workers a core in every executor."""

import pytest

from cliptide.llm import lpf, windows


def steps(df) -> int:
    """Most Python steps on a way through the plan without an exchange, as the plan is before it runs."""
    most = 0

    def below(node) -> int:
        nonlocal most
        if node.nodeName() == "AdaptiveSparkPlan":
            return below(node.executedPlan())
        children = node.children()
        held = max([below(children.apply(i)) for i in range(children.size())], default=0)
        if node.nodeName().endswith("Exchange"):
            return 0
        held += node.nodeName().endswith("InArrow")
        most = max(most, held)
        return held

    below(df._jdf.queryExecution().executedPlan())
    return most


@pytest.mark.parametrize("module, query", [(windows, windows.without_passages), (lpf, lpf.dedup)])
def test_small_findings_are_not_broadcast_into_the_filters_stage(spark, odd, monkeypatch, module, query):
    seen = []
    real = module.stage
    monkeypatch.setattr(module, "stage", lambda df, label: seen.append(steps(df)) or real(df, label))
    out = query(odd.select("doc_id", "text"))
    assert max(seen) == steps(out) == 1
    assert out.count() > 0
