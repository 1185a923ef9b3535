from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticklake.llm.chat import borrowed_pairs, preferences
from ticklake.llm.sharding import curve_tables, described, hilbert, sharded, write_shards
from ticklake.llm.url_filters import judged, links

from . import edge

T = "array<struct<role:string,text:string>>"


def test_preferences(spark):
    a = [("user", "q"), ("assistant", "yes"), ("user", "more"), ("assistant", "one <|end|>")]
    rows = [
        (1, a, a[:3] + [("assistant", "two")]),
        (2, a, a),
        (3, a, a[:2]),
        (4, a, None),
        (5, [], []),
        (6, [(None, None)], [("user", "x")]),
        (7, [("assistant", "a")] * 3000, [("assistant", "a")] * 2999 + [("assistant", "b")]),
    ]
    got = {r.id: r for r in preferences(spark.createDataFrame(rows, f"id long, chosen {T}, rejected {T}").withColumn("prompt", F.lit("clash"))).collect()}
    r = got[1]
    assert r.status == "pair" and r.n_prompt == 3
    assert r.prompt == "<|user|>\nq<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n"
    assert r.chosen_text == "<|assistant|>\none < |end|><|end|>\n"
    s, e = map(int, r.chosen_mask.split("-"))
    assert r.chosen_text[s:e] == "one < |end|><|end|>"
    s, e = map(int, r.rejected_mask.split("-"))
    assert r.rejected_text[s:e] == "two<|end|>"
    assert got[2].status == "identical" and got[2].n_prompt == 3 and got[2].chosen_text == got[2].rejected_text
    assert got[3].status == "pair" and got[3].n_prompt == 1  # each side keeps a turn
    assert [x.count("-") for x in (got[3].chosen_mask, got[3].rejected_mask)] == [2, 1]
    assert got[4].status == "incomplete" and got[4].n_prompt == 4 and got[4].chosen_text == ""
    assert got[5].status == "incomplete" and got[5].prompt == ""
    assert got[6].status == "pair" and got[6].chosen_text == "<||>\n<|end|>\n" and got[6].chosen_mask == ""
    assert got[7].n_prompt == 2999


def test_borrowed_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "t"), (1, 0, "user", "q"), (1, 1, "assistant", "a1"), (2, 0, "user", "x"), (4, 5, "assistant", None), (4, 5, "assistant", None), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in borrowed_pairs(df).collect()}
    assert sorted(got) == [0, 1, 2, 4]
    assert [t.text for t in got[0].chosen] == ["q", "a0"] and [t.text for t in got[0].rejected] == ["q", "a1"]
    assert got[2].rejected is None and [t.text for t in got[4].rejected] == [None, ""]
    assert borrowed_pairs(df.limit(0)).count() == 0 and preferences(borrowed_pairs(df.limit(0))).count() == 0


def page(url, html=None):
    return (url, html)


def test_urls(spark):
    canonical = '<html><LINK href="{}" rel=canonical><meta content="0; url={}" HTTP-EQUIV="refresh">'
    rows = [
        ("http://a.com/x", canonical.format("http://b.com/y?a=1&amp;b=2", "https://evil.NET/z")),  # blocked over an alias that is no page
        ("http://b.com/y?a=1&b=2", None),
        ("http://c.com/1", '<link rel="canonical" href="http://a.com/x">'),
        ("http://sub.Example.NET/en/1", '<link rel="canonical" href="http://evil.net/z">'),  # an explicit allow holds
        ("http://d.org/fr/", "<link rel=stylesheet href='http://evil.net/'><a rel=canonical href='http://evil.net/'>"),
        ("http://example.com/de/", ""),
        ("http://notexample.com/de/", ""),
        ("http://example.com", None),
        ("nonsense", None),
        (None, "<link rel=canonical href='http://evil.net/'>"),
        ("http://plain.com/?u=http://evil.net/", None),
        ("http://plain.com/?u=http://evil.net/", None),
        ("http://r1.com/", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").withColumns({"host": F.lit(1), "component": F.lit(2)})
    red = spark.createDataFrame([("http://r1.com/", "http://r2.com/"), ("http://r2.com/", "https://evil.NET/z"), (None, "x")], "from_url string, to_url string")
    got = {r.page_id: r for r in judged(df, redirects=red).collect()}
    assert len(got) == len(rows)
    assert [got[i].verdict for i in range(len(rows))] == ["block", "block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    assert (got[3].host, got[3].path, got[3].rule) == ("sub.example.net", "/en/1", "example.net/en/")
    assert (got[5].rule, got[6].rule, got[8].host, got[9].path) == ("example.com/de/", None, "", "")
    assert got[7].path == "" and got[1].path == "/y" and got[4].rule == "org/fr/"
    assert judged(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3)])
def test_curve(spark, dims, bits):
    """Every cell once, and neighbours on the curve are neighbours in space."""
    n = 1 << bits
    df = spark.range(n**dims).select(*[F.expr(f"cast(id div {n**k} % {n} as int)").alias(f"x{k}") for k in range(dims)])
    at = {r[0]: tuple(r[1:]) for r in df.select(hilbert([F.col(f"x{k}") for k in range(dims)], bits), "*").collect()}
    assert sorted(at) == list(range(n**dims))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(len(at) - 1))
    assert sum(map(len, curve_tables(dims)[0])) < 200


@pytest.mark.parametrize("shards,pieces", [(24, 20_000), (5, 2), (40, 1)])
def test_shards(spark, shards, pieces):
    df = edge.docs(spark, extra=False)
    got = sharded(described(df).withColumns({"slot": F.lit(1), "curve": F.lit(2)}), shards=shards, rows_per_piece=pieces).collect()
    n = len(edge.rows())
    assert len(got) == n
    count = Counter(r.shard for r in got)
    sizes = [count[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(count) <= set(range(shards))
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharded(described(edge.empty(spark))).count() == 0


def test_written_shards(spark, tmp_path):
    df = edge.docs(spark, extra=False)
    write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(edge.rows()) and set(df.columns) <= set(back.columns)


def test_url_targets(spark):
    """Tags over several lines, and targets that are no whole urls."""
    rows = [
        ("https://x.com/a/b?q=1", '<link\n  rel="canonical"\n  href="https://evil.net/z"\n>', "https://evil.net/z"),
        ("https://x.com/a/b?q=1", '<meta\n http-equiv="refresh"\n content="0;\n url=//evil.net/z">', "https://evil.net/z"),
        ("https://x.com/a/b?q=1", '<link rel=canonical href="/de/p?x=1&amp;y=2">', "https://x.com/de/p?x=1&y=2"),
        ("https://x.com/a/b?q=1", '<meta http-equiv=refresh content="0; url=\'../c/./d/..\'">', "https://x.com/c/"),
        ("https://x.com/a/b?q=1", '<link rel=canonical href="e.html#f">', "https://x.com/a/e.html#f"),
        ("https://x.com/a/b?q=1", '<link rel=canonical href="?r=../2">', "https://x.com/a/b?r=../2"),
        ("https://x.com", "<link rel=canonical href=g>", "https://x.com/g"),
        ("https://x.com/a/b", '<base\nhref="//evil.net/k/"><link rel=canonical data-href="/no" href="m">', "https://evil.net/k/m"),
        ("https://x.com/a/b", '<link rel=canonical href="/go?u=http://evil.net/">', "https://x.com/go?u=http://evil.net/"),
        ("https://x.com/a/b", '<link rel=canonical href="mailto:a@evil.net">', None),
        ("nonsense", '<link rel=canonical href="/x">', None),
    ]
    own = lambda i, x: x and x.replace("https://x.com", f"https://x{i}.com")
    df = spark.createDataFrame([(i, own(i, u), h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    assert {tuple(r) for r in links(df).collect()} == {(own(i, u), own(i, want)) for i, (u, _, want) in enumerate(rows) if want}
    pages = [(0, "https://example.com/a", '<link\nrel="canonical"\nhref="/de/a">'), (1, "https://y.com/", '<meta http-equiv="refresh"\ncontent="0; url=//evil.net/z">')]
    got = judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [r.verdict for r in got] == ["block", "block"]


def test_links_that_count(spark):
    """``rel`` of several words; names that only end like one; hidden tags; very long html."""
    to = '<link rel="{}" href="http://evil.net/z">'
    long = "<p>word " * 300_000
    yes = [
        to.format("nofollow canonical"),
        to.format("Canonical\nshortlink"),
        "<link rel='alternate canonical' href=http://evil.net/z>",
        "<link rel=canonical href=http://evil.net/z />",
        "<LINK HREF=http://evil.net/z REL=canonical>",
        "<!-- a --><script>x = '<link>'</script>" + to.format("canonical") + "<!-- b",
        "<meta data-http-equiv=x http-equiv=' refresh ' content='0;url=http://evil.net/z'>",
        long + to.format("canonical") + long,
        "<!--" + long + "-->" + to.format("canonical"),
    ]
    no = [
        to.format("not-canonical"),
        to.format("canonicals"),
        "<link data-rel=canonical href=http://evil.net/z>",
        "<link rel=canonical-x href=http://evil.net/z>",
        "<link rel=icon title='rel canonical' href=http://evil.net/z>",
        "<meta data-http-equiv=refresh content='0;url=http://evil.net/z'>",
        "<!-- " + to.format("canonical") + " -->",
        "<!--" + to.format("canonical"),
        "<script type=a>" + to.format("canonical") + "</SCRIPT >",
        "<style>" + to.format("canonical"),
        "<linkrel=canonical href=http://evil.net/z>",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, f"http://x{i}.com/", h) for i, h in enumerate([*yes, *no])], "page_id long, url string, html string")
    assert {tuple(r) for r in links(df).collect()} == {(f"http://x{i}.com/", "http://evil.net/z") for i in range(len(yes))}
    assert [r.verdict for r in judged(df).orderBy("page_id").collect()] == ["block"] * len(yes) + ["allow"] * len(no)
