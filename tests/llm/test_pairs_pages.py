"""Near-duplicates, nearest neighbours, WARC and HTML extraction."""

import io
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typeloom.llm import forest, html, nearest, tokenfiles, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- near-duplicates


def slow_sets(rows, size):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])
    return sets


def slow_components(sets, percent):
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


def check(df, rows, size, percent, **options):
    got = {r["doc_id"]: r for r in forest.near_duplicates(df, size=size, percent=percent, **options).collect()}
    sets = slow_sets(rows, size)
    want = slow_components(sets, percent)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (want[d] == d) for d, r in got.items())


def near_texts(n_groups, copies, edits, length, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    out = []
    for _ in range(n_groups):
        base = [word() for _ in range(length)]
        for _ in range(copies):
            own = base[:]
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(length)] = word()
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("size", [4, 5])
def test_forest_equals_brute_force(spark, size):
    rows = near_texts(12, 8, 4, 90, 1) + [(1000 + i, t) for i, t in enumerate(["", None, "one two", "one two", "A b C d", "a b c d", "a b c d e"])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, size, 80)


def test_large_mixed_regions_are_joined_exactly(spark):
    rows = near_texts(2, 60, 5, 60, 4)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 4, 80, region=3, first=1)


def test_a_large_component_and_others_just_below_the_threshold(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):  # copies with one or two words changed, all in one component
        own = base[:]
        for at in rng.sample(range(120), 1 + i % 2):
            own[at] = f"c{i}_{at}"
        rows.append((i, " ".join(own)))
    for i in range(150, 260):  # some four words changed, far apart: around the threshold
        own = base[:]
        for at in range(i % 20, 120, 30 - i % 3):
            own[at] = f"d{i}_{at}"
        rows.append((i, " ".join(own)))
    want = slow_components(slow_sets(rows, 4), 80)
    assert 20 < len(set(want.values())) < 111
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 4, 80, region=8, first=1)


def test_repeated_ids_link_by_any_of_their_texts(spark):
    w, z, a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "wzab")
    rows = [(1, w), (1, z), (3, z + " more"), (4, a), (2, a), (2, b), (6, b + " more"), (7, "own words only here"), (None, w), (1, None)]
    got = {(r["doc_id"], r["n_shingles"] > 0): (r["component_id"], r["kept"]) for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, True): (1, True), (1, False): (1, True), (3, True): (1, False), (4, True): (2, False), (2, True): (2, True), (6, True): (2, False), (7, True): (7, True), (None, True): (1, True)}


def test_forest_on_odd_documents(odd_docs, no_docs):
    rows = {d["doc_id"]: d["text"] for d in odd_docs.collect()}
    found = forest.near_duplicates(odd_docs, size=4).collect()
    want = slow_components(slow_sets(rows.items(), 4), 80)
    assert len(found) == odd_docs.count() and {r["doc_id"]: r["component_id"] for r in found} == want
    assert forest.keep_one(odd_docs).columns == odd_docs.columns
    assert forest.near_duplicates(no_docs).count() == 0 and forest.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("united", [0, 1 << 20])
def test_components_of_a_long_chain(spark, united):
    links = spark.range(400).selectExpr("id AS u", "id + 1 AS v").union(spark.createDataFrame([(900, 901), (5, 5)], "u long, v long"))
    got = {r["node"]: r["comp"] for r in forest.components(links.repartition(7), united).collect()}
    assert got == {**{i: 0 for i in range(401)}, 900: 900, 901: 900}


# -- nearest neighbours


def brute(vectors, query, k):
    ids = [i for i in vectors if i != query and len(vectors[i]) == len(vectors[query])]
    score = {i: float(np.dot(np.asarray(vectors[i], float), np.asarray(vectors[query], float))) for i in ids}
    return sorted(ids, key=lambda i: (-score[i], i))[:k], score


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = nearest.nearest(df, df.filter("vec_id % 20 = 0"), 20, block_rows=900).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    hits = []
    for q, found in by.items():
        want, score = brute(vectors, q, 20)
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r["vec_id"] for r in found}
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-12) for r in found)
        assert [(r["score"], -r["vec_id"]) for r in found] == sorted(((r["score"], -r["vec_id"]) for r in found), reverse=True)
        hits.append(len({r["vec_id"] for r in found} & set(want)) / 20)
    assert len(by) == 100 and np.mean(hits) >= 0.95
    assert all(np.mean(hits[i::10]) >= 0.9 for i in range(10))  # each tenth of the queries


def test_answers_of_a_block():
    assert [nearest.block_answers(20, b) for b in (1, 2, 10, 100, 10_000)] == [20, 20, 11, 5, 2]
    rng = np.random.default_rng(0)
    assert (rng.binomial(20, 0.1, 100_000) <= nearest.block_answers(20, 10)).all()


def test_few_vectors_are_verified_and_equal_ones_score_alike():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((20_000, 64))
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    vectors[[5, 700, 19_000]] = vectors[5]
    index, hits = nearest.CollisionIndex(vectors, 1.0), []
    for i in range(0, 20_000, 500):
        rows, scores = index.search(vectors[i], 20, np.array([i]))
        exact = vectors @ vectors[i]
        exact[i] = -9
        hits.append(len(set(rows[np.argsort(-scores)[:20]].tolist()) & set(np.argsort(-exact)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.95 and index.verified < 0.12 * 40 * 20_000
    rows, scores = index.search(vectors[6], 20_000)
    assert len({scores[rows == r][0] for r in (5, 700, 19_000)}) == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 1.0, 1.0]), (10, [-1.0, 3.0]), (10, [-1.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in nearest.nearest(df, df, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [1, 2, 10], 1: [2, 0, 10], 2: [1, 0, 10], 10: [0, 1, 2]}
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_many_equal_vectors_tie_by_id(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") < 200, 0.5).otherwise(F.rand(3))).alias("embedding"))
    rows = nearest.nearest(df, df.filter("vec_id = 150"), 20).orderBy("rank").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    assert [r["vec_id"] for r in rows] == brute(vectors, 150, 20)[0]


# -- WARC


class Held:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, pos):
        return self.data[pos : pos + n]


def archive(payloads, packed):
    members = [warc.record_bytes(i, f"https://e.org/{i}", p, None) for i, p in enumerate(payloads)]
    members = [warc.gzip_member(m) for m in members] if packed else members
    return members


def pages_of(data, first=0, last=None):
    events = list(warc.SalvageReader(Held(data), first, last))
    return [warc.page_of(e) for e in events if isinstance(e, warc.Record)], [e for e in events if isinstance(e, warc.Gap)]


PAYLOADS = [b"", b"a" * 10, b"<p>WARC/1.1 inside\r\n</p>", bytes(range(256)) * 300, b"\r\n\r\n", b"x" * 200_000, b"\x1f\x8b\x08 not a member"]


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archives(packed):
    found, gaps = pages_of(b"".join(archive(PAYLOADS, packed)))
    assert not gaps and [(p[0], p[1], p[2]) for p in found] == [(i, len(x), warc.digest32(x)) for i, x in enumerate(PAYLOADS)]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "tail"])
def test_salvage(packed, damage):
    members = archive(PAYLOADS, packed)
    broken = members[3]
    if damage == "flip":
        members[3] = broken[: len(broken) // 2] + bytes([broken[len(broken) // 2] ^ 0xFF]) + broken[len(broken) // 2 + 1 :]
    elif damage == "cut":
        members[3] = broken[: len(broken) // 3]
    elif damage == "junk":
        members[3] = b"\x1f\x8b\x08junk WARC/1.1 junk" * 5000
    else:
        members[6] = members[6][:-7]
    data = b"".join(members)
    found, gaps = pages_of(data)
    lost = 6 if damage == "tail" else 3
    assert [p[0] for p in found] == [i for i in range(7) if i != lost]
    start = sum(map(len, members[:lost]))
    assert gaps[0].offset == start and gaps[-1].end == start + len(members[lost]) and all(a.end == b.offset for a, b in zip(gaps, gaps[1:]))


@pytest.mark.parametrize("packed", [True, False])
def test_ranges_read_each_record_once(packed):
    data = b"".join(archive(PAYLOADS * 3, packed))
    for step in (1000, 50_000):
        ids = [p[0] for at in range(0, len(data), step) for p in pages_of(data, at, at + step)[0]]
        assert ids == list(range(21))


def test_round_trip_of_odd_pages(spark):
    rows = [(3, "u3", "same"), (1, None, "same"), (2, "u2\r\nX: y", None), (5, "u5", ""), (4, "u4", "é" * 5000), (1, None, "same"), (9, "u9", "own")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=lambda r: r[0])
    body = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i in sorted(body):
        first.setdefault(body[i], i)
    want = sorted(((i, len(body[i]), warc.digest32(body[i]), "response" if first[body[i]] == i else "revisit", None if first[body[i]] == i else first[body[i]]) for i, _, _ in rows), key=lambda r: r[0])
    assert got == want
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, least_bytes=4).collect()}
    assert small == {1: "response", 2: "response", 3: "revisit", 4: "response", 5: "response", 9: "response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_long_headers_and_null_ids_come_back(spark):
    url = "data:text/html," + "x" * (3 << 20)
    rows = [(1, url, "same"), (2, "u", "same"), (None, "u", "same"), (None, "v", "own"), (None, "v", "own"), (None, None, None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    key = lambda r: str(r)
    want = [(1, 4, "response", None), (2, 4, "revisit", 1), (None, 4, "revisit", 1), (None, 3, "response", None), (None, 3, "response", None), (None, 0, "response", None)]
    assert sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    for packed in (True, False):
        record = warc.record_bytes(7, url, b"x", None)
        found, gaps = pages_of((warc.gzip_member(record) if packed else record) + b"".join(archive([b"y"], packed)))
        assert not gaps and [p[0] for p in found] == [7, 0]


def test_members_of_several_records():
    records = archive(PAYLOADS, False)
    single = warc.gzip_member(warc.record_bytes(9, None, b"z", None))
    found, gaps = pages_of(warc.gzip_member(b"".join(records)) + single)
    assert not gaps and [p[0] for p in found] == [*range(7), 9]
    broken = records[3][:-501] + bytes([records[3][-501] ^ 0xFF]) + records[3][-500:]
    member = warc.gzip_member(b"".join([*records[:3], broken, *records[4:]]))
    found, gaps = pages_of(member + single)
    assert [p[0] for p in found] == [0, 1, 2, 4, 5, 6, 9] and "content" in gaps[0].reason
    start = len(b"".join(records[:3]))
    assert f"bytes {start} to {start + len(broken)} of" in gaps[0].reason and gaps[0].end == len(member)
    cut = warc.gzip_member(b"".join(records))[:-60]
    found, gaps = pages_of(cut + single)
    assert [p[0] for p in found] == [*range(6), 9] and (gaps[0].offset, gaps[-1].end) == (0, len(cut))


def test_lost_rows_fail(spark, tmp_path):
    members = archive(PAYLOADS, True)
    path = tmp_path / "b.warc.gz"
    path.write_bytes(b"".join(members[:-1]))
    known = [(str(path), path.stat().st_size, [6])]
    assert warc.read_archives(spark, known).count() == 6
    with pytest.raises(Exception, match="7 rows were written, 6 were read back"):
        warc.read_archives(spark, [(*known[0][:2], [7])]).collect()


def test_a_plain_archive_is_not_cut_inside_a_payload(spark, tmp_path):
    inner = warc.record_bytes(99, None, b"inner", None)
    payloads = [b"a" * 5000, b"x" * 3000 + b"\r\n" + inner + b"y" * 3000, b"z"]
    path = tmp_path / "p.warc"
    path.write_bytes(b"".join(archive(payloads, False)))
    rows = warc.read_archives(spark, [(str(path), path.stat().st_size)], split_bytes=1024).collect()
    assert sorted(r["page_id"] for r in rows) == [0, 1, 2] and all(r["reason"] is None for r in rows)


def test_gaps_are_logged(spark, tmp_path):
    members = archive(PAYLOADS, True)
    members[2] = members[2][:-3]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    events = warc.read_archives(spark, [(str(path), path.stat().st_size)], split_bytes=4096).collect()
    assert sorted(r["page_id"] for r in events if r["reason"] is None) == [0, 1, 3, 4, 5, 6]
    assert [(r["offset"], r["end"]) for r in events if r["reason"]] == [(sum(map(len, members[:2])), sum(map(len, members[:3])))]
    assert io.BytesIO(path.read_bytes()).read(2) == b"\x1f\x8b"


# -- HTML


def test_parser_repairs():
    nodes = html.parse("<body><p><b>one<br>two<p>three &amp; <i>four</i></div><ul><li>a<li>b</ul><script>'<p>no</p>'</script>tail")
    assert [t for n in nodes for _, t in sorted(n.blocks)] and " ".join(t for _, t in sorted(b for n in nodes for b in n.blocks)) == "one two three & four a b tail"
    assert html.parse(None)[0].tag == "#root" and len(html.parse("")) == 1
    for odd in ("<", "<a", "<p class='x", "<!--", "</p></p>", "<![CDATA[x", "<p " + "'" * 5000, "a<b c>d", "\x00<p>\x00"):
        html.parse(odd)
    deep = "<div>" * 3000 + "x"
    assert html.extract([deep], html.trained()) is not None


def test_table_parts_without_end_tags():
    nodes = html.parse("<table><caption>t<colgroup><col><thead><tr><th>a<th>b<tbody><tr><td>c<td><table><tr><td>d</table><tr><td>e<tfoot><tr><td>f</table>")
    assert [n.tag for n in nodes if nodes[n.parent].tag == "table"] == ["caption", "thead", "tbody", "tr", "tfoot"]
    assert [sum(n.parent == i and n.tag == "tr" for n in nodes) for i, g in enumerate(nodes) if g.tag in ("thead", "tbody", "tfoot")] == [1, 2, 1]
    assert " ".join(t for _, t in sorted(b for n in nodes for b in n.blocks)) == "t a b c d e f"


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>x</title><meta a=b><body><article><p>one</article></html>", "one"),
    ("<head><style>x</style><link a=b><article><p>one</p></article>", "one"),
    ("<head><meta a=b>one<p>two", "one two"),
    ("<head><noscript><div>no</div></noscript><script>no</script></head><body><p>one", "one"),
    ("<head><noscript><link a=b><body><p>one</p></body>", "one"),
    ("<body><noscript>no<p>one</p><p>two</p>", "one two"),
    ("<div><noscript><p>no</p></noscript><p>one</p></div>", "one"),
    ("<select><option>no<option>no<p>one</p>", "one"),
    ("<select><option>no<option>no</select><p>one</p>", "one"),
    ("<button>no<article><p>one</p></article><button>no</button>two", "one two"),
    ("<button><div>no</div></button><p>one", "one"),
    ("<body><svg><path d=x><p>one</p><svg><text>no</text></svg>", "one"),
    ("<div><svg><text>no</div>one", "one"),
    ("<template><div>no<svg/></div><template><p>no</p></template><p>no</p></template>one", "one"),
])
def test_muted_elements_without_end_tags(page, text):
    assert " ".join(t for _, t in sorted(b for n in html.parse(page) for b in n.blocks)) == text


def test_a_page_without_head_end_tag_has_its_text():
    page = "<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><article><p>" + "</p><p>".join(f"This is sentence {i}, with some words in it, and a full stop." for i in range(8)) + "</p></article></body></html>"
    found = html.extract([page, page.replace("</head>", "")], html.trained())
    assert found[0] == found[1] and "sentence 7" in found[0]


def test_held_out_pages():
    rng, model = random.Random(123), html.trained()
    wrong = total = 0
    for _ in range(120):
        page, main = html.training_page(rng)
        found = set(re.findall(r"q\d+q", html.extract([page], model)[0]))
        total += len(set(re.findall(r"q\d+q", page)))
        wrong += len(found ^ main)
    assert wrong / total < 0.02


SAID = [f"This is sentence {i} of the story, with some words in it, and it ends with a stop." for i in range(6)]
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("page", [
    "<body><div class='topNav'>{menu}</div><div class='post-body'>{story}</div><div id='footer-2'>Made by us</div></body>",
    "<table><tr><td class='leftMenu'>{menu}</td><td><div class='entry-content'>{story}</div></td></tr></table><div class=copyright>All rights kept by us</div>",
    "<div class='wrapper outer'><header>{menu}</header><main>{story}</main><div class='comments'><div class='comment'><p>I read it, and I liked it very much, thanks.</p></div></div></div>",
    "<nav>{menu}</nav><article>{breaks}</article><div class='cookieNotice'><p>We use cookies here, do you agree with that?</p></div>",
    "<div id='site-header'>{menu}</div><section class='articleBody'>{story}</section><aside>{menu}</aside>",
])
def test_pages_of_other_shapes(page):
    story, breaks = "".join(f"<p>{t}</p>" for t in SAID), "<br><br>".join(SAID)
    assert html.extract([page.format(menu=MENU, story=story, breaks=breaks)], html.trained()) == [" ".join(SAID)]


def test_attribute_tokens_are_hashed_and_learned():
    node = html.parse("<div class='sideBar x9' ID=main-2 data-x=ads></div>")[1]
    bucket = lambda t: html.zlib.crc32(t.encode()) % html.TOKENS
    assert node.tokens == tuple(map(bucket, ("side", "bar", "main")))
    odds = html.trained().odds
    assert odds[bucket("footer")] < -1 and odds[bucket("comments")] < -1 and odds[bucket("entry")] > 1 and odds[bucket("neverseen")] == 0


def test_decoding_has_no_contradictions():
    rng = random.Random(5)
    for _ in range(30):
        nodes = html.parse(html.training_page(rng)[0])
        out = html.decode(nodes, np.random.default_rng(1).normal(size=len(nodes)) * 3)
        assert len(out) == len(nodes)
    nodes = html.parse("<div><p>keep this text here</p><p>x</p></div>")
    assert all(html.decode(nodes, np.full(len(nodes), 9.0))) and not any(html.decode(nodes, np.full(len(nodes), -9.0)))


def test_article_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    model = html.trained()
    import html as entities

    for page, got in zip(pages, html.extract([p["html"] for p in pages], model)):
        article = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        plain = re.sub(r"<(?:p|h1|br|/p|/h1)[^>]*>", " ", article)
        assert got == re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", plain))).strip()


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "plain words only, without any tag at all in them.", "z"), (3, "<nav><a href='/'>Home</a></nav>", "z")], "page_id long, html string, url string")
    rows = html.main_text(df).collect()
    assert [r["text"] for r in rows if r["html"] in (None, "")] == ["", ""] and len(rows) == 4
    assert [r["text"] for r in rows if r["html"] and "nav" in r["html"]] == [""]
    assert html.main_text(df.limit(0)).count() == 0


def test_ill_formed_pages_take_linear_time():
    """Five megabytes of what a browser repairs, of each kind; text is kept where no tag is."""
    started = time.process_time()
    pages = {
        "tags without an end": "<a " * 1_250_000,
        "quotes without an end": '<a b="' * 800_000,
        "end tags that close nothing": "<b>x" * 500_000 + "</i>" * 500_000,
        "quotes around every >": '<a ">"' * 800_000,
        "one name": "<a" * 2_500_000,
        "end tags beyond a scope": "<i><div>" + "<b>" * 400_000 + "</i>" * 400_000,
        "muted": "<svg>" * 300_000 + "<g>" * 300_000,
        "raw text": "<script>" + "</script " * 500_000,
        "one attribute": "<a " + "x" * 4_000_000 + ">t",
    }
    found = {name: html.parse(page) for name, page in pages.items()}
    assert time.process_time() - started < 90
    assert found["tags without an end"][0].own == len(pages["tags without an end"].strip()) and found["one attribute"][0].blocks == [(0, "t")]


def test_a_file_with_another_mask_is_refused(tmp_path):
    writer = tokenfiles.PartWriter(str(tmp_path), 0, tokenfiles.id_type(1000), 16)
    writer.add([(1, np.arange(20))])
    name, _ = writer.close()
    table = pa.ipc.open_file(name + ".arrow").read_all()
    mask = pa.FixedSizeListArray.from_arrays(pa.array([i % 2 == 0 for i in range(32)]), 16)
    with pa.ipc.new_file(name + ".arrow", table.schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), mask], schema=table.schema))
    reader = tokenfiles.PartReader(str(tmp_path), name)
    for read in (lambda: reader.sequence(0), lambda: reader.ids(0, 20)):
        with pytest.raises(ValueError):
            read()


def test_answers_that_a_block_cut_are_searched_again(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 20 = 0")
    whole = nearest.nearest(df, queries, 5, block_rows=100, risk=0.0)
    cut = nearest.nearest(df, queries, 5, block_rows=100, risk=0.999)
    assert nearest.block_answers(5, 4, 0.999) == 1
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_an_id_with_several_vectors_counts_once(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 2.0]), (2, [5.0, 1.0]), (3, [1.0, 1.0])]
    for given in (rows, rows[::-1]):
        found = nearest.nearest(spark.createDataFrame(given, "vec_id long, embedding array<double>"), spark.createDataFrame([(3, [1.0, 1.0])], "vec_id long, embedding array<double>"), 2)
        assert [(r["vec_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(2, 2.0), (1, 1.0)]


def test_an_index_has_as_many_arrays_as_projections():
    for d in (6, 64, 200):
        assert nearest.CollisionIndex(np.random.default_rng(1).standard_normal((50, d)), 30.0).m == 65
