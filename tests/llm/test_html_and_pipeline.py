import random
import re

import numpy as np
import pytest

from tessera.llm.html_extract import HostRuns, extract_text, frequent, read_page, signature, unique_runs


def text_of(page):
    blocks, _, _, found = read_page(page)
    return "\n".join(blocks) if found else None


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(1)</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad 0 --><div class="ad">buy</div>%s<footer>&copy; end</footer></body></html>"""


@pytest.mark.parametrize(
    "inner,want",
    [
        ("<article><h1>A &amp; B</h1><p>x  y\n z<p>second <b>bold</b>text<br>line</article>", "A & B\nx y z\nsecond boldtext line"),
        ("<article><p><b>One<br><p>Two</p><p>Three", "One\nTwo\nThree"),
        ("<main><header><h1>H</h1></header><aside>side</aside><p>t</p><form>f<input></form><div class='comments'><p>c</p></div><p>u</p></main>", "H\nt\nu"),
        ("<div role='main'><ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table></div>", "a\nb\n1 2"),
        ("<article><div id=cookie-notice>no</div><p>a < b &lt;c&gt; &#233;&eacute;&nbsp;x</p><article class=comment>r</article></article>", "a < b <c> éé x"),
        ("<article><script>if (a<b) '</article>'</script><p hidden>h</p><p>t &am</p></article>", "t &am"),
        ("<article></article>", ""),
    ],
)
def test_structure(inner, want):
    assert text_of(PAGE % inner) == want


def test_awkward_pages(spark):
    pages = [(0, "http://h.example/1", None), (1, None, ""), (2, "x", "<"), (3, "http://h.example/2", "<article><p>same</article>"), (3, "http://h.example/2", "<article><p>same</article>"), (None, None, "<article>" + "<p>w" * 5000), (5, "u", "<p>plain text & more"), (6, "u", "<div " + "a" * 1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as host", "1 as part")
    got = extract_text(df).collect()
    assert len(got) == len(pages)
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[(3, "http://h.example/2")]["text"] == "same" and by[(5, "u")]["text"] == "plain text & more"
    assert by[(None, None)]["n_chars"] == 2 * 5000 - 1 and by[(1, None)]["text"] == ""
    assert extract_text(df.where("false")).count() == 0


def test_host_boilerplate():
    menu, foot = "home news sport culture contact about", "all rights are kept by the makers of this page"
    pages = [[menu, f"article number {k} tells of thing{k} and of other{k} matters", foot] for k in range(8)]
    got = unique_runs(pages)
    assert all(len(g) == 1 and g[0] == p[1] for g, p in zip(got, pages, strict=True))
    assert unique_runs([[menu, "x"], [menu, "y"]]) == [[menu, "x"], [menu, "y"]]  # two pages may be copies
    assert unique_runs([[], []]) == [[], []]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("copies", [3, 100])
def test_copies_of_an_unmarked_page_stay(copies):
    menu = "home news sport culture contact about"
    pages = [[menu, prose(0), prose(1)]] * copies + [[menu, prose(k)] for k in range(2, 14)]
    got = unique_runs(pages)
    assert got == [p[1:] for p in pages]  # the menu goes, the copied text stays
    assert unique_runs([[prose(0), prose(1)]] * copies) == [[prose(0), prose(1)]] * copies
    near = [[prose(0), f"read by {k}", prose(1), prose(100 + k, 8)] for k in range(copies)]
    assert unique_runs(near) == near
    assert unique_runs([[menu], *pages[copies:]])[0] == [menu]  # no page is left without a word


def brute_runs(pages, n=6):
    """The pages that hold each run of n words."""
    found = {}
    for p, blocks in enumerate(pages):
        words = " ".join(blocks).split()
        for s in range(len(words) - n + 1):
            found.setdefault(tuple(words[s : s + n]), set()).add(p)
    return found


def test_repeated_runs_match_brute_force():
    r = random.Random(7)
    menu = [prose(k, 9) for k in range(4)]
    pages = [[r.choice(menu), prose(100 + k, r.randint(60, 90)), *r.sample(menu, 2), "end"] for k in range(40)]
    host = HostRuns(pages)
    want = brute_runs(pages)
    assert len(host.hash) == len(want) == len(set(host.hash.tolist()))
    assert sorted(map(len, want.values())) == sorted(len(set(host.pair_page[host.pair_run == k].tolist())) for k in range(len(host.hash)))
    run, alike, classes = host.evidence(np.stack([signature(p) for p in pages]))
    assert len(classes) == 40  # no near copies here
    common = {w for w, p in want.items() if len(p) >= 4}
    assert len(frequent(run, len(classes))) == len(common)
    covered = set()
    for p, blocks in enumerate(pages):
        words = " ".join(blocks).split()
        for s in range(len(words) - 5):
            if tuple(words[s : s + 6]) in common:
                covered |= {(p, s + k) for k in range(6)}
    for p, (blocks, kept) in enumerate(zip(pages, host.kept(frequent(run, len(classes))), strict=True)):
        words = " ".join(blocks).split()
        assert " ".join(kept).split() == [w for k, w in enumerate(words) if (p, k) not in covered]


def test_large_hosts_are_judged_like_small_ones(spark):
    menu, foot = "home news sport culture contact about", "all rights are kept by the makers"
    pages = [(k, f"http://big.example/{k}", f"<ul><li>{menu}</ul><div><p>{prose(k)}</p></div><p>{foot}</p>") for k in range(60)]
    pages += [(100 + k, "http://big.example/copy", f"<ul><li>{menu}</ul><div><p>{prose(999)}</p></div>") for k in range(30)]
    pages += [(200 + k, "http://marked.example/a", f"<nav>{menu}</nav><article><p>{menu}</p></article><div>{menu} x{k} y</div>") for k in range(5)]
    pages += [(300 + k, "http://mixed.example/a", f"<nav>{menu}</nav><article><p>{prose(k)}</p></article>") for k in range(9)] + [(400, "http://mixed.example/b", f"<div>{menu}</div><p>{prose(77)}</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    whole = {r["page_id"]: r["text"] for r in extract_text(df).collect()}
    parts = {r["page_id"]: r["text"] for r in extract_text(df, group_words=700).collect()}
    assert whole == parts and len(whole) == len(pages)
    assert all(whole[k] == prose(k) for k in range(60)) and all(whole[100 + k] == prose(999) for k in range(30))
    assert all(whole[200 + k] == menu for k in range(5))  # a marked article stays, repeated or not
    assert whole[400] == prose(77)  # the menu of the host's marked pages is known


def test_articles_go_through_the_host_array_too(spark):
    menu, foot = "home news sport culture contact about", "all rights are kept by the makers"
    pages = [(k, f"http://h.example/{k}", f"<nav>{menu}</nav><article><p>{prose(k)}</p></article><p>{foot}</p>") for k in range(20)]
    pages += [(20, "http://h.example/quote", f"<nav>{menu}</nav><article><p>{prose(20)}</p><p>They wrote {menu} there</p><p>{foot} and more</p></article>")]
    pages += [(21, "http://h.example/plain", f"<div>{menu}</div><p>{prose(21)}</p><p>{foot}</p>"), (22, "http://h.example/none", None)]
    pages += [(30 + k, "http://h.example/copies", f"<article><p>{prose(40)}</p></article>") for k in range(5)]  # articles are no evidence
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for words in (1 << 20, 300, 5):  # one part, several, more parts than pages
        got = {r["page_id"]: (r["text"], r["n_restored"]) for r in extract_text(df, group_words=words).collect()}
        assert len(got) == len(pages) and all(got[k] == (prose(k), 0) for k in range(20)) and all(got[30 + k] == (prose(40), 0) for k in range(5))
        assert got[20] == (f"{prose(20)}\nThey wrote {menu} there\n{foot} and more", 13)  # 6 and 7 words that the array alone would cut
        assert got[21] == (prose(21), 0) and got[22] == ("", 0)


def test_array_of_whole_pages_matches_brute_force():
    r = random.Random(3)
    menu = [prose(k, 8) for k in range(3)]
    pages = [[r.choice(menu), prose(100 + k, 20), r.choice(menu), prose(200 + k % 5, 30)] for k in range(30)]
    host = HostRuns(pages, outside=[3] * 30)
    outer, whole = brute_runs([p[:3] for p in pages]), brute_runs(pages)
    assert len(host.hash) == len(whole) and len(host.pair_run) == sum(map(len, outer.values()))
    run, _, classes = host.evidence(np.stack([signature([prose(500 + k)]) for k in range(30)]))
    common = {w for w, p in outer.items() if len(p) >= 3}
    assert len(classes) == 30 and len(frequent(run, 30)) == len(common)
    texts, restored = host.checked(frequent(run, 30), [None] * 15 + [3] * 15, [3] * 30)
    assert texts[:15] == [p[3] for p in pages[:15]] and restored == [0] * 30
    assert texts[15:] == [p[1] for p in pages[15:]]
    assert HostRuns([]).checked(np.zeros(0, np.uint64), [], []) == ([], [])


def test_copied_rows_of_an_unmarked_page_stay(spark):
    text = prose(0)
    pages = [(k // 2, f"http://h.example/{k // 2}", f"<div><p>{text}</p></div>") for k in range(12)]
    got = extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 12 and all(r["text"] == text for r in got)


def test_pages_hold_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html

    got = {r["page_id"]: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?h1|/?p|br)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns
        rows = out.collect()
        before = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in rows} <= before
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert sizes[-1] < sizes[0] and sizes[-1] > 0.5 * sizes[0]
    out = P.STAGES[-1][1](spark, docs, sf_small)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    whole = P.run(spark, sf_small)
    assert whole.select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    import corpus_pipeline as P
    from tests.llm.helpers import AWKWARD, docs_frame

    docs_frame(spark, [*AWKWARD, (3, "a"), (None, "null id"), (3, "other")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some benchmark words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    empty = tmp_path / "empty"
    docs_frame(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, str(empty)).count() == 0
