"""What the plans must look like, and that the library stands without the training-data subpackage."""

import ast
from pathlib import Path

from foliant.plans import retrieval

ROOT = Path(__file__).resolve().parents[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_legs_are_bounded_before_they_are_ranked(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(retrieval.vector_topk(spark, sf_dir))
    assert "TakeOrderedAndProject" in plan(retrieval.text_topk(spark, sf_dir))


def test_the_few_results_are_broadcast(spark, sf_dir):
    assert "BroadcastHashJoin" in plan(retrieval.hybrid_search(spark, sf_dir))


def test_scans_read_only_what_they_need(spark, sf_dir):
    from foliant.plans import construction

    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan(construction.scan_project(spark, sf_dir))


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "foliant").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            names = [n for x in ast.walk(ast.parse(p.read_text())) for n in ([a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""] if isinstance(x, ast.ImportFrom) else [])]
            assert not any(n.startswith("foliant.llm") for n in names), p
