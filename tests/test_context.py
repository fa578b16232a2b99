"""Ranks of candidates by reference, in the query and in its SQL."""

import random
from difflib import SequenceMatcher

from test_matching import BANK, STL, bank, stl

from ledgerloom.operators import candidates
from ledgerloom.plans import queries_matching


def test_candidates_are_ranked_by_how_alike_references_are(spark, monkeypatch):
    b = spark.createDataFrame([bank("B1", ref="UTIB555X"), bank("B2", ref=None)], BANK)
    s = spark.createDataFrame([stl("S1", utr="QQ"), stl("S2", utr="UTIB999"), stl("S3", utr="UTIB5556")], STL)
    monkeypatch.setattr(queries_matching, "_pairs", lambda fx: candidates.pair_with_menus(
        b, candidates.candidate_menus(b, s)))
    got = queries_matching.candidate_context_features(None).collect()
    ranks = {(r.bank_record_id, r.target_id): r.candidate_rank_by_reference for r in got}
    assert ranks == {("B1", "S3"): 1, ("B1", "S2"): 2, ("B1", "S1"): 3,
                     ("B2", "S1"): 1, ("B2", "S2"): 2, ("B2", "S3"): 3}
    plan = queries_matching.pair_base_features(None)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan  # no similarity where it is not asked for


def test_similarity_in_sql_equals_python():
    import duckdb

    draw = random.Random(5)
    texts = ["", "AB", "ABAB"] + ["".join(draw.choice("AB01") for _ in range(draw.randint(1, 9))) for _ in range(40)]
    pairs = [(a, b) for a in texts for b in draw.sample(texts, 8)]
    con = duckdb.connect()
    con.execute("create table t_pairs (reference varchar, utr varchar)")
    con.executemany("insert into t_pairs values (?, ?)", pairs)
    parts = queries_matching.SIMILARITY_SQL
    rows = con.execute(f"with t_references as ({parts['t_references']}), t_similarity as ({parts['t_similarity']}) "
                       "select * from t_similarity").fetchall()
    assert {(a, b): r for a, b, r in rows} == {
        (a, b): SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs}
