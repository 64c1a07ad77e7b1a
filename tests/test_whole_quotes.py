"""Containment of whole titles."""

from tidemark.plans import checklists


def test_whole_title_must_be_held(spark, tmp_path):
    papers = [("a", "The closing quote arrived late", "Then the closing\n quote  arrived late."), ("b", "The closing quote arrived late", "The closing bell."), ("c", "Late quote", "A quote came late."), ("d", "Late", None), ("e", None, "why?")]
    spark.createDataFrame(papers, "paper_id string, title string, text string").coalesce(1).write.parquet(str(tmp_path / "corpus.parquet"))
    got = {r["paper_id"]: r["supported"] for r in checklists.quote_containment(spark, str(tmp_path)).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True}
