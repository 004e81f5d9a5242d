"""Pages of every kind, tidy and not."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bracketry.sources import pages
from bracketry.sources.pagebatch import read_tables
from bracketry.sources.tagstream import read_page


def framed(spark, *html):
    return pages.with_page(spark.createDataFrame(list(enumerate(html)), "id long, html string"))


def texts(table):
    return [[c["text"] for c in r["cells"]] for r in table["rows"]]


def test_unclosed_and_nested():
    p = read_page("<table class=x><tr><th>A<th>B<tr><td>1 &amp; 2<p>x<p>y<table><tr><td>in</table>z<td><a href='/q\n'>L<b>k</b></a></table>after")
    outer, inner = p["tables"]
    assert texts(outer) == [["A", "B"], ["1 & 2 x yz", "Lk"]] and outer["parent"] == -1
    assert texts(inner) == [["in"]] and inner["parent"] == 0
    assert outer["rows"][1]["cells"][0]["parts"] == ["1 & 2", "x", "yz"] and outer["rows"][1]["cells"][1]["links"] == [{"href": "/q", "text": "Lk"}]
    assert read_page("<td>no table</td></table></tr><li>x</ul>")["tables"] == []
    assert texts(read_page("<table><td>a<td>b</tr><td>c")["tables"][0]) == [["a", "b"], ["c"]]
    three = read_page("<table><tr><td><table><tr><td><table><tr><td>deep")["tables"]
    assert [t["parent"] for t in three] == [-1, 0, 1] and texts(three[2]) == [["deep"]]


def test_sections_items_and_headings():
    p = read_page("<h2 class=c>One<table><thead><tr><th>h</thead><tbody><tr><td>1<thead><tr><th colspan=3>Round 2</thead><tr><td>2</table><ul><li>a<ul><li>b</ul>c<li class=d>e</ul><h1>T</h1>")
    assert [r["section"] for r in p["tables"][0]["rows"]] == ["thead", "tbody", "thead", ""]
    assert [(i["text"], i["class"]) for i in p["items"]] == [("ac", ""), ("b", ""), ("e", "d")]
    assert [(h["level"], h["text"]) for h in p["headings"]][1] == (1, "T")


def test_text_that_is_no_text():
    p = read_page("<table><tr><td>a<!-- <td>no --><script>'<td>x</td>'</script><style>td{}</style>b<td title='>'>c&lt;td&gt;<td>1 < 2 <3</table><!-- open <table>")
    assert texts(p["tables"][0]) == [["ab", "c<td>", "1 < 2 <3"]] and len(p["tables"]) == 1


def test_spans():
    p = read_page("<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td rowspan=9>d<tr><td>e<td>f<tr><td colspan=0 rowspan=x>g</table>")["tables"][0]
    assert [[c["col"] for c in r["cells"]] for r in p["rows"]] == [[0, 1], [1, 2], [0, 1], [0]]


def test_large_pages_take_linear_time():
    for bad in ("<table>", "<td>", "<ul><li>", "</li></ul>", '<a href="x', "<!--", "<script>", "<", "&amp", "<p a='", "<td x=\"a' ", "<h1><li>", "<table><tr><td rowspan=65534>"):
        began = time.perf_counter()
        read_page("<table><tr>" + bad * (1_000_000 // len(bad)))
        assert time.perf_counter() - began < 20, bad
    wide = "<table><tr>" + "<td rowspan=9>" * 30_000 + "<tr>" + "<td>" * 100_000
    assert len(read_page(wide)["tables"][0]["rows"][1]["cells"]) == 100_000


def test_grid_and_records(spark):
    html = "<table><tr><td>junk<tr><th>Name<th>Result<th colspan=2>Score<tr><td>Ann<td>win<td>1<td>2<tr><td rowspan=2>Bo<td>loss<td colspan=2>3<tr><td>draw</table>"
    d = framed(spark, html, None, "<table><tr><th>Name</table>")
    got = pages.records(d, ["id"], ["Result", "name", "SCORE"]).orderBy("row").collect()
    assert [(r.id, r.name and r.name.text, r.Result.text, r.SCORE and r.SCORE.text) for r in got] == [(0, "Ann", "win", "1"), (0, "Bo", "loss", "3"), (0, None, "draw", None)]
    cells = {(r.row, r.col): r.text for r in pages.grid(pages.table_rows(d, ["id"]), ["id"]).where("id = 0").collect()}
    assert cells[3, 0] == cells[4, 0] == "Bo" and cells[3, 3] == "3" and cells[1, 3] == "Score" and (5, 0) not in cells


def stat_page(rounds, mess=""):
    two = lambda a, b: f"<td class=c><p>{a}</p><p>{b}</p>{mess}"
    who = "<td><a href='/f/aa'>A</a><a href='/f/bb'>B</a>"
    main = "".join(f"<thead><tr><th colspan=10>Round {r}</thead><tr>{who}{two(r, 0)}{two('3 of 5', '1 of 2')}{two('60%', '50%')}{two('9 of 10', '2 of 4')}{two('1 of 1', '0 of 3')}{two('x', '---')}{two(0, 2)}{two('', 1)}{two('1:05', '--')}" for r in rounds)
    zones = "".join(f"<thead><tr><th colspan=9>Round {r}</thead><tr>{who}{two('', '')}{two('', '')}{two('1 of 2', '0 of 1')}{two('1 of 1', '0 of 0')}{two('1 of 2', '1 of 1')}{two('2 of 4', '1 of 2')}{two('1 of 1', '')}{two('0 of 0', '0 of 0')}" for r in rounds)
    totals = f"<table><tr><th>totals<tr>{who}{two(7, 7)}</table>"
    return f"{totals}<table><thead><tr>{'<th>h' * 10}</thead><tbody>{main}</table><table>{zones}<tr><td>short</table>"


def test_round_stats(spark):
    d = framed(spark, stat_page([1, 2, 3]), stat_page([1], "</td></td>"), "<table><tr><th>Round 1</table>", None)
    got = {(r.id, r["round"], r.who): r for r in pages.round_stats(d, ["id"]).collect()}
    assert len(got) == 8
    a, b = got[0, 2, "aa"], got[0, 2, "bb"]
    assert (a.knockdowns, a.sig_landed, a.sig_attempted, a.total_landed, a.takedowns_attempted, a.submissions, a.reversals, a.control, a.head_attempted, a.distance_landed, a.side) == (2, 3, 5, 9, 1, 0, 0, 65, 2, 2, 0)
    assert (b.knockdowns, b.sig_landed, b.submissions, b.reversals, b.control, b.leg_landed, b.clinch_landed, b.side) == (0, 1, 2, 1, 0, 1, 0, 1)


def test_labels_and_cards(spark):
    items = "<ul><li>Height: <b>5' 11\"</b><li><i>Reach:</i> -- <li>STANCE: Orthodox</li><li>stance: second</ul>"
    card = lambda j, rows: f"<table><tr><td colspan=3 class=judge><a href='judge/{j}/x'>Judge  {j}</a><tr class=top-row><td class='top-cell q'>Van Dam<td class=top-cell>O'Neil{rows}<tr class=bottom-row><td>29</table>"
    row = lambda *x: "<tr class=decision>" + "".join(f"<td class=list> {v} </td>" for v in x)
    nested = f"<table><tr><td>{card(1, row(1, 10, 9) + row(2, 9, 10) + row('-', 'x', 1))}<td>{card(2, row(1, 10, 8))}</table>"
    d = framed(spark, items + nested, "")
    assert [tuple(r) for r in pages.labelled(d, ["id"], {"height": "Height", "reach": "Reach", "stance": "Stance", "dob": "DOB"}).where("id = 0").collect()] == [(0, "5' 11\"", None, "Orthodox", None)]
    assert sorted(tuple(r)[2:] for r in pages.cards(d, ["id"]).collect()) == [("Judge 1", "vandam", "oneil", 1, 10, 9), ("Judge 1", "vandam", "oneil", 2, 9, 10), ("Judge 2", "vandam", "oneil", 1, 10, 8)]


def test_odds(spark):
    head = "<table><thead><tr><th>x<th data-b=1><a href=b>Bet <b>One</b></a>promo<th data-b=2>Two</thead><tbody>"
    price = lambda b, v: f"<td class=but-sg data-li='[{b}, 1, 7]'><span>{v}</span><span>▲</span>"
    side = lambda m, name, *p: f"<tr><th>{f'<a href=/cnadm/matchups/{m}>e</a>' if m else ''}<a href='/fighters/{name}'>{name} X</a>{''.join(p)}"
    prop = lambda label, *p: f"<tr class=pr><th>{label}{''.join(p)}"
    html = head + prop("early", price(1, "+100")) + side(7, "Ann", price(1, "+150"), price(2, "-200")) + side("", "Bo", price(1, "-170"), price(9, "+1")) + prop("Ann wins by TKO/KO", price(1, "+300"), price(2, "+500")) + prop("ann X wins by decision", price(1, "+700"))
    html += prop("X wins by submission", price(1, "+300")) + prop("Ann wins by KO/TKO", price(1, "+900")) + prop("Over 2", price(1, "n/a"), "<td><span>+100</span>") + side(8, "Cy", price(2, "+100")) + side("", "Di", price(2, "-100")) + side("", "Ed", price(1, "+111")) + prop("Cy wins by decision", price(1, "+222")) + side(9, "Last", price(1, "+120"))
    d = framed(spark, html + "</table>", "<table><tr><th>none</table>")
    g = pages.odds_grid(d, ["id"])
    one = {r.matchup: r for r in pages.consensus(g, ["id"]).collect()}
    assert set(one) == {"7", "8"}
    r = one["7"]
    assert (r.a, r.b, r.best_a, r.median_a, r.n_a, r.best_b, r.n_b) == ("Ann X", "Bo X", 2.5, 2.0, 2, 1.588, 1)
    assert r.methods == {"a_ko": 5.0, "a_dec": 8.0}
    assert (one["8"].best_a, one["8"].best_b, one["8"].methods) == (2.0, 2.0, {})
    assert {x.book for x in g.collect()} == {"Bet One", "Two"}
    assert pages.odds_grid(d.limit(0), ["id"]).count() == 0


def test_a_page_is_read_once(spark):
    plan = pages.round_stats(framed(spark, stat_page([1])), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_page_items_leave_other_references_as_written(spark, tmp_path):
    from bracketry.plans import registry
    from tests import oracle

    html = ['<h1>a &amp;&amp</h1><li><a href="/x">x</a></li>', "<h1>t = &quot;0b96</h1>", "<h1>no <b>end</h1><h1>  1 &lt;\n 2</h1>", "<p>none", None, "<h1>open<h2>x</h2>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    next((tmp_path / "pages").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert oracle.difference(registry.QUERIES["q_page_items"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), registry.SQL["q_page_items"]) == ""


def of_batch(html):
    """Tables of each page out of the columns of a batch, and how many pages were plain."""
    got, plain = {}, 0
    for k, t in enumerate(read_tables(pa.array(["before<td>", *html], pa.string())[1:])):
        tables, rows = [(p, n, []) for p, n in zip(t.table_page.tolist(), t.table_no.tolist(), strict=True)], []
        for i in t.row_table.tolist():
            rows.append([])
            tables[i][2].append(rows[-1])
        texts, pieces, links = t.texts(np.arange(len(t.cell_row))).to_pylist(), t.strings(t.piece_at, t.piece_size).to_pylist(), t.strings(t.link_at, t.link_size).to_pylist()
        for c, r in enumerate(t.cell_row.tolist()):
            data = t.attrs[t.cell_attr[c]] if t.cell_attr[c] >= 0 else {}
            own, its = slice(t.first_piece[c], t.first_piece[c] + t.pieces[c]), range(t.first_link[c], t.first_link[c] + t.links[c])
            rows[r].append((bool(t.cell_head[c]), {k: v for k, v in data.items() if k.startswith("data-")}, texts[c], pieces[own], [(t.attrs[t.link_attr[j]]["href"], links[j]) for j in its]))
        for p, n, x in tables:
            got.setdefault(p, []).append((n, x))
        plain += len({p for p, _, _ in tables}) if k == 0 else 0
    return [got.get(p, []) for p in range(len(html))], plain


def walked(html):
    cell = lambda c: (c["head"], dict(c["data"]), c["text"], c["parts"], [(a["href"], a["text"]) for a in c["links"]])
    return [(t["table"], [[cell(c) for c in r["cells"]] for r in t["rows"]]) for t in read_page(html or "")["tables"]]


def test_batches_of_pages_are_as_pages_alone():
    r = random.Random(3)
    tidy = ["<table>", "</table>", "<tr>", "<td>", "<th>", "</td>", "</tr>", "<tbody>", "</thead>", "<p>", "</p>", "<br>", "<a href=u>", "</a>", "x", " y ", "<td data-b=2 class=k>", "<span>", "&lt;", "z  z", "<div>", "<!-- c -->", "<title>t</title>", "<a href='/x y'>", "\n", "é", "▲", "\u2003", "\u00a0"]
    odd = ["<ul>", "<li>", "</ul>", "<td data-li=\"[2\" data-b='>' >", "<!--", "-->", "<script>1<2</script>", "<script><td></script>", "</script>", "<h1>", "<p a='", "'", '"', ">", "<td x=\"a' ", "<a href>", "</a x='>'>", "<p/>", "<li", "<td\0>", "&#160;", "&am", "p;", "<", "1 < 2", "<TD class=x>", "<td", "</", "<textarea>"]
    pages_ = [None, ""]
    for _ in range(4000):
        bits = r.choice([tidy, tidy, tidy + odd])
        pages_.append(r.choice(["", "<table>", "<ul><li>a<table><tr>", "<table><tr><td>"]) + "".join(r.choice(bits) for _ in range(r.randint(0, 40))))
    plain = 0
    for at in range(0, len(pages_), 61):
        got, n = of_batch(pages_[at : at + 61])
        plain += n
        for html, x in zip(pages_[at : at + 61], got, strict=True):
            assert x == walked(html), html
    assert plain > 1000
    assert of_batch([])[0] == [] and of_batch([None])[0] == [[]]


def test_rounds_of_batches_of_pages(spark):
    r = random.Random(5)
    two = lambda: f"<td><p>{r.choice(['1 of 2', '3', ' 7 of 9', '0:59', '12:61', '99999999999', '', '+4', '1 2', '5 of 3x', '-3'])}</p><p>{r.choice(['1 of 2', '3', '2:10', 'x', '6 of 60'])}</p>"

    def line():
        who = f"<tr><td><a href='/f/{r.choice('ab')}'>x</a><a href='/f/{r.choice(['b', 'c/', '/', ''])}'>y</a>" if r.random() < 0.3 else "<tr><td><a href='/f/aa'>x</a><a href=/f/bb>y</a>"
        return r.choice([f"<tr><td>Round {r.choice(['1', '2', '02', '99999999999', 'x'])}", "<thead><tr><th colspan=3> Round\n3 <b>x</b></thead>", "<tr><td>short"] + [who + "".join(two() for _ in range(r.randint(7, 10)))] * 3)

    html = ["".join(r.choice(["<table>", "<table>", "<table><tr><td><table>"]) + "".join(line() for _ in range(r.randint(0, 6))) + r.choice(["</table>", ""]) for _ in range(r.randint(0, 4))) for _ in range(800)]
    d = framed(spark, stat_page([1, 2, 3]), stat_page([1], "</td></td>"), "<table><tr><th>Round 1</table>", None, *html)
    want = pages.round_stats(d, ["id"])
    got = pages.page_rounds(d, ["id"]).select(want.columns)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 200


def test_matchups_of_batches_of_pages(spark):
    r = random.Random(7)
    price = lambda: r.choice([f"<td data-li='[{r.choice('123')}, 1]'><span>{r.choice(['+150', '-200', '+99', '300', '+101.5', 'n/a', '-99999999999'])}</span><span>▲</span>", "<td>", "<td data-li=x>+200", "<td data-li='[ \"2'>-110"])

    def row():
        name = r.choice(["Ann", "Bo X", "Cy &amp; D", "Di"])
        kinds = [f"<th><a href='/cnadm/matchups/{r.choice('778')}'>e</a><a href='/fighters/{name}'>{name}</a>", f"<th><a href='/fighters/{name}'>{name}</a>", f"<th>{name} wins by {r.choice(['TKO/KO', 'submission', 'Decision', 'KO/TKO', 'luck'])}", "<td>no head", "<th><a href='/cnadm/matchups/x'>e</a><a href='/fighters/q'>q</a>"]
        return "<tr>" + r.choice(kinds) + "".join(price() for _ in range(r.randint(0, 4)))

    heads = lambda: "".join(r.choice(["<th>junk", f"<th data-b={r.choice('123')}><a href=b>B{r.randint(1, 4)}</a>x", "<th data-b>No"]) for _ in range(r.randint(0, 4)))
    html = ["".join("<table>" + heads() + "".join(row() for _ in range(r.randint(0, 12))) + r.choice(["</table>", "</table>", ""]) for _ in range(r.randint(0, 3))) for _ in range(1500)]
    d = framed(spark, None, *html)
    g = pages.odds_grid(d, ["id"])
    want, got = pages.consensus(g, ["id"]), pages.consensus_of_places(pages.page_matchups(d, ["id"]), ["id"])
    assert got.select(want.columns).dtypes == want.dtypes
    rows = lambda x: sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in t) for t in x.select(want.columns).collect()), key=repr)
    assert rows(got) == rows(want) and got.count() > 150
    # medians as Spark has them
    mid = g.groupBy("id", "table", "matchup", "place", "label", "who").agg(F.median("price").alias("m")).where("place = 0").groupBy("id", "table", "matchup").agg(F.max("m").alias("m"))
    told = {(x.id, x.table, x.matchup): x.median_a for x in got.collect() if x.median_a is not None}
    assert {(x.id, x.table, x.matchup): x.m for x in mid.collect()} == told
