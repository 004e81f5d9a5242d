"""What queries do on larger tables: one pass where two would differ, work that grows with the input, candidates that stay few."""

from __future__ import annotations

from bracketry.plans import registry
from tests import oracle

SMALL = f"{oracle.DATA}/sf0.001"


def scans(df, name: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_blend_losses_are_summed_once(spark):
    assert scans(registry.QUERIES["q_blend_selection"](spark, SMALL), "o_orderkey") and scans(registry.QUERIES["q_blend_selection"](spark, SMALL), "Relation [") == 1


def test_alike_names_are_not_met_by_day_alone(spark, monkeypatch):
    """Feeds with a name in common with a contest are settled without all contests of their days."""
    from bracketry.plans import resolution as R

    left = []
    monkeypatch.setattr(R, "candidates", lambda f, n, own=R.candidates: left.append(f.count()) or own(f, n))
    fed = R.feed(spark, SMALL).count()
    assert registry.QUERIES["q_fuzzy_pairs"](spark, SMALL).count() == fed and registry.QUERIES["q_product_pairs"](spark, SMALL).count() == fed
    assert fed > 50 and left == [0, 0]


def test_unique_match_leaves_out_feeds_with_two(spark):
    from bracketry.plans import resolution as R

    f = spark.sql("select 1L feed_id, date '2001-01-02' fed, 'anna alvarez 1' x, 'boris brandt 2' y")
    n = spark.sql("select id contest_id, date '2001-01-04' day, 'boris brandt 3' a, 'nna alvarez 1' b, '' sa, '' sb from range(100)")
    assert R.by_ends(f, n, 8).count() == R.MOST_BY_ENDS


def test_lines_of_contests_are_cut_by_their_number(spark, monkeypatch):
    """Tasks hold so many lines, whatever the input, and no step after the join moves them again."""
    from bracketry.plans import rounds

    monkeypatch.setattr(rounds, "LINES", 500)
    assert rounds.cards(spark, SMALL).rdd.getNumPartitions() >= 12
    assert registry.QUERIES["q_margin_per_round"](spark, SMALL).rdd.getNumPartitions() >= 12


def test_page_match_joins_titles_not_pages(spark):
    plan = registry.QUERIES["q_page_match"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate [day") >= 3


def test_pages_are_read_in_parts(spark, monkeypatch):
    from bracketry.plans import pages as plans
    from bracketry.sources import pages

    monkeypatch.setattr(plans, "PAGES", 100)
    assert plans._round_pages(spark, SMALL).rdd.getNumPartitions() >= 15
    import pyarrow as pa

    assert pages._stretches(pa.array(["x" * 1_500_000, None, "y" * 1_000_000, "z" * 3_000_000, ""])) == [2, 3, 4, 5]
    assert pages._stretches(pa.array([], pa.string())) == []


def test_shared_opponents_by_lists_and_by_rows(spark, monkeypatch):
    """Both ways give the SQL's rows; lists are joined without a row for each opponent of each contest."""
    from bracketry.plans import lookups

    con = oracle.connect(SMALL)
    df = registry.QUERIES["q_common_neighbours"](spark, SMALL)
    assert oracle.difference(df, con, registry.SQL["q_common_neighbours"]) == ""
    assert df._jdf.queryExecution().optimizedPlan().toString().count("opponent#") and "Aggregate [contest_id" not in df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(lookups, "LISTED", 20)
    assert oracle.difference(registry.QUERIES["q_common_neighbours"](spark, SMALL), con, registry.SQL["q_common_neighbours"]) == ""


def test_sets_of_common_grams_meet_by_parts_of_sets(spark):
    """Sets out of a few grams: nearly all pairs share a gram, rarest or not, and only those that may be alike are compared."""
    import random

    from bracketry.operators import fuzzy

    r = random.Random(4)
    sets = [set(r.sample(range(150), 45)) for _ in range(400)]
    sets += [s - {min(s)} | {999} for s in sets[:30]] + [{1}, {1, 2}, {1, 2, 3}]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, g array<int>")
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) > 0.85 * len(a | b)}
    met = {tuple(x) for x in fuzzy.may_be_alike(rows, 0.85).collect()}
    assert len(want) == 30 and want <= met and len(met) < 200


def test_titles_of_large_groups_are_met_by_day(spark):
    """What a row looks back to is found for its title and day: rows of a title are not multiplied by the titles like it."""
    plan = registry.QUERIES["q_near_dup_7d"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [title") >= 1 and "Aggregate [doc_id" not in plan


def test_rounds_of_pages_are_not_shuffled(spark):
    """Pages are read where they are written, and their rows stay there."""
    plan = registry.QUERIES["q_page_rounds"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan


def test_odds_of_pages_are_not_shuffled(spark):
    """A page of any size is no row of Spark's with all its cells, and matchups stay where their page is read."""
    plan = registry.QUERIES["q_page_odds"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan
