"""Archives, licence scans, extraction, URL filters, pieces and toxicity against brute force or a round trip, and their edge cases."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from parley.llm import html, licences, pieces, queries, toxicity, urls, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, id bigint, k string, toxic int")


# --- archives


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id bigint, url string, html string, digest string")


PAGES = [(1, "http://a/é", "é" * 600), (2, "http://b", "é" * 600), (5, None, "é" * 600), (3, "http://c\r\nX: y", "short"), (4, "http://d", "short"), (6, "http://e", None), (7, "http://f", ""), (8, "http://g", "z" * 3_000_000), (9, "http://h", "y" * 1000), (9, "http://h", "y" * 1000), (10, "u", "y" * 999)]


def test_archives_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages_of(spark, PAGES), folder, roll=2000)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(index, folder, payload=False).collect())
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        most = max(p for p, _, x in PAGES if (x or "") == (h or ""))
        revisit = len(data) >= 1000 and most != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", most if revisit else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    full = {r["page_id"]: r["payload"] for r in warc.read(index.where("page_id in (3, 8, 5)"), folder).collect()}
    assert {k: bytes(v) for k, v in full.items()} == {3: b"short", 8: b"z" * 3_000_000, 5: ("é" * 600).encode()}
    for path in (tmp_path / "w").glob("*.warc.gz"):  # any reader of archives can read them as one stream
        raw = gzip.decompress(path.read_bytes())
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert sum(p.stat().st_size for p in (tmp_path / "w").glob("*.warc.gz")) == index.agg(F.sum("length")).first()[0]


def test_damaged_archives_are_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages_of(spark, PAGES[:1]), folder)
    row = index.first()
    (tmp_path / "w" / row["file"]).write_bytes(warc.record(1, "u", b"other", row["digest"], None).ljust(row["length"], b"\0"))
    with pytest.raises(Exception, match="digest|incorrect|invalid|Error"):
        warc.read(index, folder).collect()


def test_reads_are_dealt_by_bytes(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    body = "".join(chr(33 + random.Random(4).randrange(90)) for _ in range(200))
    rows = [(i, "u", f"{i} " + body * (2000 if i < 40 else 1)) for i in range(80)]
    index = warc.write(spark.createDataFrame([(i, u, hashlib.sha512(h.encode()).hexdigest() * 4000, "x", 3) for i, u, h in rows], "page_id bigint, url string, html string, file string, offset int"), folder)
    size = index.agg(F.sum("length")).first()[0]
    assert warc.read(index, folder).rdd.getNumPartitions() == max(1, min(4, size >> 20))
    assert warc.read(index, folder, payload=False).count() == 80


def test_archives_of_pages_with_other_columns(spark, tmp_path):
    names = "file, offset, length, digest, payload, record_type, refers_to, n".split(", ")
    rows = [(1, "u", "a" * 1200, *range(8)), (2, "u", "a" * 1200, *range(8))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, " + ", ".join(f"{n} int" for n in names))
    folder = f"file://{tmp_path}/w"
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(warc.write(df, folder), folder, payload=False).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None)}


def test_empty_archive(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    assert warc.read(warc.write(pages_of(spark, []), folder), folder).count() == 0


def test_ranges():
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (300, 900)], span=200, gap=90) == [(0, 3, 0, 105), (3, 4, 300, 900)]
    assert warc.ranges([]) == []


# --- licences


def plain_places(text):
    words = WORD.findall(lower(text))
    found = []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def test_licences(spark):
    rng = random.Random(2)
    vocab = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "é", "x1", "the"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    notice = "".join(licences.NOTICES["mit-grant"].replace("[", "").replace("]", "")).split()
    rows += [(100, None), (101, ""), (102, "Licensed under CC BY-NC 4.0.\nApache  LICENSE"), (103, "gnu general public licenseé"), (104, "cc"), (105, "cc by"), (105, "cc by"), (106, "mit license " * 20000)]
    rows += [(200, "start " + " ".join(notice) + " end"), (201, " ".join(notice[:10] + ["added", "words"] + notice[10:])), (202, " ".join(notice[:6]))]
    rows += [(300, "released under the released under the dog"), (301, "we released under the moon, released under the sea"), (302, "Licensed under CC BY 4.0"), (303, "Licensed under the Apache License, Version 1.1"), (304, "licensed under the " * 9), (305, "Released under the MIT license."), (306, "Licensed under the Apache License, Version 2.0."), (307, " ".join(reversed(notice)))]
    got = licences.scan(docs_of(spark, rows)).collect()
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(str((r["doc_id"], *[r[f] for f in fields])) for r in got) == sorted(str((i, *plain_places(t))) for i, t in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[102]["labels"] == "apache,cc-by,cc-by-nc" and by[200]["labels"] == by[201]["labels"] == "mit-grant" and by[202]["labels"] == "" and by[100]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got) and by[201]["score"] <= by[200]["score"] == 1.0
    assert [by[i]["labels"] for i in range(300, 308)] == ["", "", "cc-by", "apache", "", "mit,mit-release", "apache,apache-2.0", ""] and by[300]["score"] == by[301]["score"] == 0.0
    assert licences.scan(docs_of(spark, [])).count() == 0


def plain_cover(words, template):
    """The largest share of a template's words under grams in order within the span's length, every start tried, by dynamic programming."""
    grams, best = {}, 0.0
    for i, g in enumerate(template.grams):
        grams.setdefault(g, []).append(i)
    pairs = [(p, a) for p in range(len(words) - 2) for a in grams.get(" ".join(words[p : p + 3]), [])]
    for i, (first, _) in enumerate(pairs):
        near = [x for x in pairs[i:] if x[0] < first + int(len(template.words) * licences.STRETCH)]
        chains = []  # of each pair, the words under the chain of most grams that ends with it
        for p, a in near:
            before = max(((n, c) for (q, b), (n, c) in zip(near, chains, strict=False) if q < p and b < a), key=lambda x: (x[0], len(x[1])), default=(0, frozenset()))
            chains.append((before[0] + 1, before[1] | set(range(a, a + 3))))
        best = max([best, *(len(c) / len(template.words) for _, c in chains if template.must <= c)])
    return best


def test_licence_labels_are_those_of_brute_force(spark):
    rng, rows = random.Random(21), []
    notices = [t for t in licences.templates({}, licences.NOTICES)]
    noise = ["the", "software", "license", "of", "under", "alpha", "beta"]
    for i in range(60):
        words = list(rng.choice(notices).words)
        for _ in range(rng.choice([0, 1, 3, len(words) // 4])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["zeta"], [words[at], "zeta"]])
        start, keep = rng.choice([0, 0, rng.randrange(len(words) + 1)]), rng.choice([1.0, 1.0, 0.7, 0.4])
        words = words[start : start + int(len(words) * keep)]
        rows.append((i, " ".join([rng.choice(noise) for _ in range(12)] + words + [rng.choice(noise) for _ in range(12)])))
    got = {r["doc_id"]: r for r in licences.scan(docs_of(spark, rows), phrases={}).collect()}
    for i, t in rows:
        want = {n.label: plain_cover(t.split(), n) for n in notices}
        stands = {k: v for k, v in want.items() if v >= licences.SHARE}
        assert got[i]["labels"] == ",".join(sorted(stands)), (i, want)
        assert abs(got[i]["score"] - max(stands.values(), default=0.0)) < 0.1
    assert sum(bool(r["labels"]) for r in got.values()) > 20


def test_long_texts_are_scanned_in_parts(monkeypatch):
    text = "x " * 500 + "Released under\nthe MIT license " * 3 + "é y " * 500 + "cc by"
    grams = licences.Grams(licences.templates(licences.PHRASES, licences.NOTICES))
    want, chunks = grams.found(text), licences.flat_chunks
    assert want[0] == len(WORD.findall(lower(text))) and "mit license" in want[2] and want[2][-1] != ""
    for size in (1, 7, 100):
        monkeypatch.setattr(licences, "flat_chunks", lambda t, s=size: chunks(t, s))
        assert grams.found(text) == want


# --- extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>One</a><li>Two</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p><b>First   &eacute;<br>line<p>Second &lt;p&gt;</p><aside>beside</aside><div class="cookie-notice">Accept</div><form><p>Name</p></form>
<section class="comments"><p>me too</p></section><ul><li>a<li>b</ul></article><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & tail\nFirst é line\nSecond <p>\na\nb"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""
    assert html.main_text("no markup  at all") == "no markup at all"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"
    assert html.main_text("<article><p>cut off &am") == "cut off &am"
    assert html.main_text("a < b") == "a < b"


@pytest.mark.parametrize("odd", ["</>", "</3>", "<a title=it's>", "<i \"x>", "<a title='open>", "<i a = '>' b=\"'>\">", "<i a= >"])
def test_text_after_malformed_markup_stays(odd):
    assert html.main_text(f"<article><p>before {odd} after<p>last</article>") == "before after\nlast"


@pytest.mark.parametrize("whole", ["<article style=\"overflow:hidden\">Text</article>", "<article aria-hidden=\"false\">Text</article>", "<main><p data-id=\"share-1\">Text</main>", "<body class=\"has-sidebar\"><article>Text</article>", "<html class=\"no-touch search-page\"><article>Text</article>", "<article class=\"post has-comments\"><header class=\"entry-header\">Text</header></article>"])
def test_marks_of_other_attributes_hide_nothing(whole):
    assert html.main_text(whole) == "Text"


@pytest.mark.parametrize("around", ["<div class=site-header>x</div>", "<div id=Cookie_Notice>x</div>", "<div class='a sideBar'>x</div>", "<article class=comment>x</article>", "<p hidden>x</p>", "<div role=navigation>x</div>"])
def test_surroundings_go(around):
    assert html.main_text(f"<body>{around}<div><p>Text</div>") == "Text"


def shapes(sources):
    return [html.Page(s, True) for s in sources]


def test_wrapper_is_inferred():
    pages = shapes(f"<html><body><ul>{'<li>x</li>' * n}</ul>{extra}<div><p>text {n}</p></div></body></html>" for n, extra in ((1, ""), (3, "<hr>"), (2, "")))
    assert html.expression(pages, "/html/body") == "(?:ul (?:li (?:\\# )/ )+/ )(?:hr / )?(?:div (?:p (?:\\# )/ )/ )".replace("\\#", "#")


def random_page(rng, depth=0):
    return "".join(f"<{t}>{random_page(rng, depth + 1) if depth < 4 and rng.random() < 0.7 else 'x'}</{t}>" for t in rng.choices(["div", "section", "ul", "h2", "table", "pre"], k=rng.randint(0, 4)))


def test_every_page_matches_its_wrapper():
    rng = random.Random(8)
    for _ in range(30):
        pages = shapes(random_page(rng) for _ in range(6))
        whole = re.compile(html.expression(pages))
        assert "|" not in whole.pattern
        for p in pages:
            assert whole.fullmatch("".join(f"{t} " for t in p.shape))
    own, other = shapes(["<div>x</div>"] * 2), shapes(["<div><p>x</div>"])[0]
    assert not re.fullmatch(html.expression(own), "".join(f"{t} " for t in other.shape))


def test_diverse_and_deep_pages_are_quick(spark):
    import time

    rng = random.Random(3)
    sources = ["".join(f"<{t} class=c{rng.randrange(40)}>w{i}</{t}>" for i, t in enumerate(rng.choices(["div", "p", "ul", "h3"], k=400))) for _ in range(200)]
    sources += ["<div>" * 100_000 + "deep" + "</p>" * 100_000, "<p>" + "long &amp; " * 200_000]
    at = time.time()
    nodes = html.Nodes()
    for s in sources:
        nodes.add("h", s)
    assert time.time() - at < 10 and html.main_text(sources[-2]) == "deep" and len(html.main_text(sources[-1])) == 7 * 200_000 - 1


def plain_region(texts):
    """A host's region and fixed paths as the docstring of ``regions`` says, from its pages' blocks."""
    by: dict[str, dict[int, list]] = {}
    for i, t in enumerate(texts):
        for path, main, around, text, links in html.Page(t).blocks:
            if not around:
                by.setdefault(path, {}).setdefault(i, []).append((text, links, main))
    off, data, mains = set(), [], []
    for path, on in by.items():
        same = len({"\n".join(x[0] for x in v) for v in on.values()}) == 1
        main = any(x[2] for v in on.values() for x in v)
        menu = any(path in html.Page(texts[i]).several for i in on) and sum(x[1] for v in on.values() for x in v) >= html.LINKS * sum(len("\n".join(x[0] for x in v)) for v in on.values())
        if not main and len(on) * 2 >= len(texts) and ((same and len({texts[i] for i in on}) >= html.FIXED_PAGES) or menu):
            off.add(path)
        else:
            data.append(path)
            mains += [path] * main
    paths = [p.split("/") for p in mains or data]
    region = "/".join(x[0] for x in itertools.takewhile(lambda x: len(set(x)) == 1, zip(*paths, strict=False)))
    varies = any(len({"\n".join(x[0] for x in v) for v in on.values()}) > 1 for on in by.values())
    return region, sorted(off) if varies else []


def test_regions_are_those_of_brute_force(spark):
    rng, rows = random.Random(11), []
    for h in range(12):
        menu = "".join(f"<li><a href=x>m{h}{k}</a>" for k in range(4))
        for i in range(rng.randint(1, 6)):
            body = "".join(f"<p>word{rng.randrange(99)} of {i}</p>" for _ in range(rng.randint(1, 3))) + "<h2>Same heading</h2>" * rng.randint(0, 1)
            box = rng.choice([f"<div class=b><section>{body}</section></div>", f"<div class=b><section>{body}</section></div>", f"<article>{body}</article>"])
            page = f"<html><body><table><tr><td>Site {h}</table><ul>{menu}</ul>{box}<div>Fixed line</div></body></html>"
            rows += [(len(rows) + k, f"http://h{h}/{i}", page, "x") for k in range(rng.choice([1, 1, 2]))]
    df = spark.createDataFrame([(i, u, t, x, 7) for i, u, t, x in rows], "page_id bigint, url string, html string, region string, path int")
    known = df.drop("region", "path").withColumn("host", urls.host_of(F.col("url")))
    got = {r["host"]: (r["region"], r["off"]) for r in html.regions(html.infer(known)).collect()}
    for h in {r["host"] for r in known.select("host").collect()}:
        assert got[h] == plain_region([t for _, u, t, _ in rows if u.split("/")[2] == h]), h
    out = {r["page_id"]: r["text"] for r in html.main_texts(df).collect()}
    for i, u, t, _ in rows:
        assert out[i] == html.main_text(t, got[u.split("/")[2]][0], frozenset(got[u.split("/")[2]][1]))
    alone = {i: html.main_text(t) for i, _, t, _ in rows}
    assert sum(alone[i] != out[i] for i in alone) > len(rows) / 3, "without the hosts' wrappers rows change"
    patterns = {(r["host"], r["path"]): r["pattern"] for r in html.grammar(known).collect()}
    assert patterns["h0", "/html/body"].startswith("(?:table )(?:ul )") and patterns["h0", "/html/body/ul"] == "(?:li )+"


def test_fixed_parts_of_a_host_go(spark):
    page = lambda i: f"<html><body><table><tr><td><p>Site name</p></td></tr></table><blockquote><p>Story {i} with words</p><p>more of {i}</p></blockquote></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(6)] + [(50, None, None, "x"), (51, "no url", "", "x"), (52, "http://h.example/0", page(0), "x")]
    rows += [(60 + i, "http://copies.example/", page(9) + "<pre>only here</pre>", "x") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    for shipped in (1 << 20, 0):
        known = df.withColumn("host", urls.host_of(F.col("url")))
        got = {r["page_id"]: r for r in html.extract(known, html.regions(html.infer(known)), shipped).collect()}
        assert len(got) == len(rows) and got[3]["text"] == "Story 3 with words\nmore of 3" and got[52]["text"] == got[0]["text"]
        assert got[50]["text"] == "" == got[51]["text"] and got[3]["n_chars"] == len(got[3]["text"])
        assert got[61]["text"] == "Site name\nStory 9 with words\nmore of 9\nonly here", "copies of one page tell nothing apart"
    assert html.main_texts(df.limit(0)).count() == 0


def test_pages_are_matched_against_the_wrapper(spark):
    page = lambda i: f"<html><body><table><tr><td><p>Site name</p></td></tr></table><blockquote><p>Story {i} with words</p></blockquote></body></html>"
    own = spark.createDataFrame([(i, "http://h.example/", page(i), "h.example") for i in range(6)], "page_id bigint, url string, html string, host string")
    hosts = html.wrappers(own)
    other = ["<html><body><div><p>Another story</p></div><blockquote><p>a quote</p></blockquote></body></html>", "<html><body><blockquote><p>first</p></blockquote><table><tr><td><p>last</p></td></tr></table></body></html>"]
    df = spark.createDataFrame([(i, "http://h.example/", t, "h.example") for i, t in enumerate([page(9), *other])], "page_id bigint, url string, html string, host string")
    for shipped in (1 << 20, 0):
        got = {r["page_id"]: r["text"] for r in html.extract(df, hosts, shipped).collect()}
        assert got == {0: "Story 9 with words", 1: "Another story\na quote", 2: "first\nlast"}, "a page of another make has no region and no fixed parts"
    rows = {(r["path"], r["key"]): (r["place"], r["again"], r["must"]) for r in hosts.first()["frame"]}
    assert rows["/html/body", "table"] == (0, False, True) and rows["/html/body", "blockquote"] == (1, False, True)


def test_every_page_matches_its_frame(spark):
    rng = random.Random(9)
    rows = [(i, f"http://h{i % 7}/", random_page(rng), f"h{i % 7}") for i in range(70)] + [(90, "http://h1/", None, "h1")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    frames = {r["host"]: html._frame(r["frame"]) for r in html.wrappers(df).collect()}
    assert all(html.Page(t or "", frame=frames[h]).fits for _, _, t, h in rows)


# --- URLs


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url else None
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/7?x"), (2, "https://a.com/en/"), (3, "http://xcom/en/1"), (4, "http://b.net/de/1#f"), (5, "http://example.net/de/88"), (6, "http://notexample.net/de/8"), (7, None), (8, ""), (9, "mailto:x"), (10, "http://c.org"), (11, "http://c.org?u=http://d.com/en/"), (12, "x://com/en/"), (13, "a\nb://E.com/en/"), (1, "http://z.org/es/")]
    rows += [(100 + i, f"http://bad.org/p{i}") for i in range(60)] + [(200 + i, f"http://good.org/p{i}") for i in range(60)]
    labels = [(100 + i, 1) for i in range(50)] + [(200 + i, 0) for i in range(50)] + [(None, 1), (100, 0), (999, 1)]
    pages = spark.createDataFrame([(i, u, "x", 0.5) for i, u in rows], "page_id bigint, url string, host string, mean double")
    got = urls.judge(pages, spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert sorted(str((r["page_id"], r["host"], r["path"], r["rule"])) for r in got) == sorted(str((i, *plain_url(u)[:3])) for i, u in rows)
    for r in got:
        want = next((plain_url(u)[3] for i, u in rows if i == r["page_id"] and plain_url(u)[0] == r["host"]), None)
        assert r["verdict"] == (want or ("block" if r["host"] == "bad.org" else "allow"))
    assert urls.judge(pages.limit(0), spark.createDataFrame([], "page_id bigint, bad int")).count() == 0
    none = urls.judge(pages, spark.createDataFrame([], "page_id bigint, bad int"))
    assert none.where("rule IS NULL AND verdict = 'block'").count() == 0 and none.count() == len(rows)


def test_very_long_urls(spark):
    rows = [(1, "http://h.org/" + "p" * 2_000_000 + "?q"), (2, "x" * 1_000_000), (3, "http://" + "a." * 100_000 + "org/es/")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame([], "page_id bigint, bad int")).collect()}
    assert len(got[1]["path"]) == 2_000_001 and got[2]["host"] == "" and got[3]["rule"] == "org/es/"


def test_registered_domains(spark):
    want = {"www.a.com": ("a.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.com.br:8080": ("b.com.br", "com.br"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "u:p@a.b.org.": ("b.org", "org"), "me.github.io": ("me.github.io", "github.io"), "com": ("com", "com"), "": ("", ""), "a.co": ("a.co", "co"), "x.com.info": ("com.info", "info")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = urls.domains(F.col("host"))
    assert {r["host"]: (r["d"], r["s"]) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == want


def test_reputation_is_drawn_to_the_domain(spark):
    hosts = spark.createDataFrame([("a.x.org", "x.org", "org", 100, 90), ("b.x.org", "x.org", "org", 100, 95), ("c.x.org", "x.org", "org", 0, 0), ("d.y.org", "y.org", "org", 100, 2), ("e.y.org", "y.org", "org", 1, 1)], "host string, domain string, suffix string, n bigint, bad bigint")
    got = {r["host"]: r for r in urls.reputation(hosts).collect()}
    assert got["c.x.org"]["mean"] > 0.7 > 0.5 > got["e.y.org"]["mean"] > got["d.y.org"]["mean"]
    assert got["c.x.org"]["low"] < got["a.x.org"]["low"]


# --- pieces


@pytest.fixture(scope="module")
def model():
    return queries.model_bytes()


TEXTS = [None, "", " ", "  two  spaces ", "Hello world", "\n\nline\n", "日本語 テスト 😀", "a▁b ▁", "tab\tand\x00nul", "ﬁ é", "<s> </s> <unk>", "x" * 3000, " " * 40, "naïve — “quoted”"]


def test_pieces_are_sentencepieces(model):
    from sentencepiece import SentencePieceProcessor

    reference, own = SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    texts = [t or "" for t in TEXTS] + ["a" + " " * n + "b" for n in range(1, 70)] + ["\n" * 9 + "-" * 200]
    got = list(own.encode(texts))
    assert [g.tolist() for g, *_ in got] == reference.encode(texts) and all(same for *_, same in got)
    assert [own.decode(g) for g, *_ in got] == reference.decode([g.tolist() for g, *_ in got]) == [w[1:] for _, w, _ in got]
    # the rebuilt model alone, without any help of SentencePiece
    alone = pieces.Pieces(model, verify=False, threads=3)
    assert alone.true is None and [g.tolist() for g, *_ in alone.encode(texts)] == reference.encode(texts)


def test_decoding_is_the_librarys(model):
    import numpy as np

    own, rng = pieces.Pieces(model, verify=False), np.random.default_rng(2)
    for n in (0, 1, 2, 7, 60, 400):  # any ids, also bytes that are no UTF-8
        ids = np.where(rng.random(n) < 0.5, rng.integers(3, 259, n), rng.integers(3, len(own.pieces), n)).astype(np.int32)
        whole = own.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        assert own.decode(ids) == (whole[1:] if whole.startswith(" ") else whole)


def test_where_the_models_differ_sentencepiece_decides(model):
    own = pieces.Pieces(model)
    own.tokenizer.normalizer = None  # a rebuilt model that is wrong
    ids, _, same = next(own.encode(["Hello world"]))
    assert not same and ids.tolist() == own.true.encode("Hello world")


def test_long_texts_are_cut_at_borders(model, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    own, texts = pieces.Pieces(model), ["word  and\nmore " * 40, " " * 50 + "x" * 50, "", "a b"]
    want = SentencePieceProcessor(model_proto=model).encode(texts)
    for size in (1, 5, 64):
        monkeypatch.setattr(pieces, "SEGMENT", size)
        got = list(own.encode(texts))
        assert [g.tolist() for g, *_ in got] == want and [own.decode(g) for g, *_ in got] == texts and all(same for *_, same in got)


def test_unigram_models_are_rebuilt():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, True
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256))]
    rows += [(p, s, 1) for p, s in (("▁", -3.0), ("▁the", -2.0), ("t", -6.0), ("h", -6.1), ("e", -6.2), ("he", -4.0), ("▁th", -3.5), ("n", -6.3), ("▁then", -4.4))]
    for p, s, k in rows:
        m.pieces.add(piece=p, score=s, type=k)
    proto = m.SerializeToString()
    reference, own = SentencePieceProcessor(model_proto=proto), pieces.Pieces(proto)
    texts = ["the then", " then  the ", "hen thé", "", "eeee"]
    got = list(own.encode(texts))
    assert [g.tolist() for g, *_ in got] == reference.encode(texts) and all(same for *_, same in got)
    assert [own.decode(g) for g, *_ in got] == reference.decode([g.tolist() for g, *_ in got])


def test_encoded_documents(spark, model):
    rows = [*enumerate(TEXTS), (0, "again"), (None, "no id")]
    got = pieces.encode(docs_of(spark, rows), model)
    assert got.columns == ["doc_id", "id", "k", "toxic", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip", "parity"]
    out = got.collect()
    assert len(out) == len(rows) and all(r["round_trip"] and r["parity"] and r["n_tokens"] == len(r["ids"]) for r in out)
    five = next(r for r in out if r["doc_id"] == 4)
    assert five["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()
    assert pieces.encode(docs_of(spark, []), model, keep_ids=False).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs_of(spark, []), b"x" * (pieces.MODEL_BYTES + 1))


# --- toxicity


def toxic_corpus(n=900, seed=4):
    rng = random.Random(seed)
    vocab, bad = [f"w{rng.randrange(10**6)}" for _ in range(400)], ["vileword", "nastyé", "grimthing"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad).title()
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    rows += [(2001, None), (2002, ""), (2003, "w " * 50000 + "vileword"), (None, "vileword"), (1, rows[1][1])]
    labels += [(None, 1, 1), (5555, 0, 1), (1, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs_of(spark, rows), lab).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r for r in got}[2003]["cosine"] > 0
    by = {r["doc_id"]: r for r in got}
    for i in range(900):
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i]["predicted"] == (i % 5 == 0) == (by[i]["score"] >= 0.7), i
    assert by[2003]["predicted"] == by[None]["predicted"] == 1 and by[2001]["predicted"] == by[2002]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got) and set(by[5]["evidence"]) <= {i for i, _, t in labels if t}
    assert not any(zlib.crc32(str(e).encode()) % 3 == 1 for r in got for e in r["evidence"])
    kept = toxicity.clean(docs_of(spark, rows), lab)
    assert kept.columns == ["doc_id", "text", "id", "k", "toxic"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in rows if not any(w in lower(t) for w in ("vileword", "nasty", "grimthing")))


def test_toxicity_of_very_long_texts_and_other_columns(spark):
    rows, labels = toxic_corpus(300)
    long = " ".join(f"plain{i % 5000}" for i in range(400_000))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    df = docs_of(spark, [*rows, (5000, long), (5001, None)]).withColumnRenamed("k", "u").withColumn("weight", F.lit(1)).withColumn("sig", F.lit("x"))
    kept = toxicity.clean(df, lab)
    assert kept.columns == df.columns and {5000, 5001} <= {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_toxicity_without_labels(spark):
    rows, _ = toxic_corpus(20)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs_of(spark, rows), none).collect()} == {(0.5, 0)}
    assert toxicity.score(docs_of(spark, []), none).count() == 0


def test_index_is_exact(monkeypatch):
    rng = random.Random(1)
    import numpy as np

    for common in (1, 10, 1000):
        monkeypatch.setattr(toxicity, "COMMON", common)
        rows = []
        for r in range(500):
            idx = np.array(sorted(rng.sample(range(30 * (r % 3), 30 * (r % 3) + 40), rng.randint(1, 6))))
            w = np.array([rng.random() + 0.1 for _ in idx])
            rows.append((idx, w / np.sqrt(w @ w)))
        index = toxicity.Index(rows, 100, block=16)
        dense = np.zeros((500, 100))
        for r, (idx, w) in enumerate(rows):
            dense[r, idx] = w
        for q in range(0, 500, 7):
            cos = dense @ dense[q]
            cos[q] = 0
            at, got = index.nearest(np.append(rows[q][0], 105), np.append(rows[q][1], 0.5), 10, skip=q)
            want = np.sort(cos)[::-1][:10]
            assert np.allclose(got, want[want > 0], atol=1e-5) and np.allclose(cos[at], got, atol=1e-5)
        assert index.visited < 72 * index.n_blocks or common == 1000
    assert not len(toxicity.Index([], 5).nearest(np.array([1]), np.array([1.0]), 3)[0])


def plain_features(text):
    count: dict[str, int] = {}
    for w in WORD.findall(lower(text)):
        for x in (w, *("^" + w[:k] for k in toxicity.BEGINNINGS if len(w) > k)):
            count[x] = count.get(x, 0) + 1
    return count


def test_features_are_counted():
    features, texts = toxicity.Features(), ["Vileword vile viles-vileword, a A\tab ééééé ééé é GRIM grims 1x xxxxxxxx  ", "x", "日本語テキスト abc"]
    seen: dict[str, int] = {}
    for t in texts:
        idx, tf = features.counts(t)
        want = plain_features(t)
        assert sorted(tf.tolist()) == sorted(want.values()) and len(set(idx.tolist())) == len(idx)
        for x in set(WORD.findall(lower(t))):  # a word alone has its features within those of the text
            one = features.counts(x)
            assert set(one[0].tolist()) <= set(idx.tolist()) and len(one[0]) == len(plain_features(x))
            seen[x] = one[0][0]
    for t in (None, "", " -- "):
        assert len(features.counts(t)[0]) == 0


def test_scores_are_those_of_brute_force(spark):
    import numpy as np

    rows, labels = toxic_corpus(300, seed=9)
    rows += [(900, "other words"), (901, "vileword other"), (902, "")]
    docs, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, lab, examples=40).collect()}
    text = {i: plain_features(t) for i, t in rows}
    few = toxicity.told_apart(toxicity.featured(docs.selectExpr("doc_id id", "text").join(toxicity.sample(lab, "doc_id", "toxic", toxicity.TEACHERS), "id")))
    y, weight = {r["id"]: r["toxic"] for r in few.collect()}, {r["id"]: r["weight"] for r in few.collect()}
    chosen = [r["id"] for r in toxicity.chosen(few, 40).collect()]
    part = {c: sum(weight[i] for i in y if y[i] == c) / sum(weight[i] for i in chosen if y[i] == c) for c in (0, 1)}
    vocabulary = {x for i in chosen for x in text[i]}
    size = [sum(1 for i in y if y[i] == c) for c in (0, 1)]
    total = [sum(weight[i] for i in y if y[i] == c) for c in (0, 1)]
    rarity = (total[0] / size[0]) / (total[1] / size[1])
    mean = size[1] / (size[1] + rarity * size[0])

    def worth(x):
        a, b = (sum(1 for i in y if y[i] == c and x in text[i]) if x in vocabulary else 0 for c in (1, 0))
        told = (a + toxicity.PRIOR * mean) / (a + rarity * b + toxicity.PRIOR)
        gain = max(0.0, np.log(told / (1 - told)) - np.log(mean / (1 - mean)))
        return (1 + np.log((len(rows) + 1) / (sum(x in t for t in text.values()) + 1))) * (toxicity.FLOOR + gain**2)

    known = {x: worth(x) for x in {x for t in text.values() for x in t}}
    vec = {i: {x: (1 + np.log(n)) * known[x] for x, n in t.items()} for i, t in text.items()}
    norm = {i: np.sqrt(sum(w * w for w in v.values())) for i, v in vec.items()}

    def vote(i, skip=None):
        cos = {j: sum(w * vec[j].get(x, 0) for x, w in vec[i].items()) / norm[i] / norm[j] for j in chosen if j != skip and text[j] and text[i]}
        best = sorted((j for j in cos if cos[j] > 0), key=lambda j: (-cos[j], j))[: toxicity.NEIGHBOURS]
        if not best:
            return None, {}
        w = {j: weight[j] * part[y[j]] / (1.05 - min(1.0, cos[j])) for j in best}
        return sum(w[j] * y[j] for j in best) / sum(w.values()), {j: cos[j] for j in best}

    own = [(vote(i, skip=i)[0], y[i], weight[i] * part[y[i]]) for i in chosen if text[i]]
    at, height = toxicity.rising(*(np.array(x, float) for x in zip(*[o for o in own if o[0] is not None], strict=True)))
    for i, _ in rows:
        raw, near = vote(i)
        assert len(got[i]["evidence"]) == len(near), i
        if near:
            assert np.isclose(got[i]["cosine"], max(near.values()), atol=1e-4) and abs(got[i]["score"] - np.interp(raw, at, height)) < 0.01, i
            assert np.allclose(sorted(near.values()), sorted(sum(w * vec[j].get(x, 0) for x, w in vec[i].items()) / norm[i] / norm[j] for j in got[i]["evidence"]), atol=1e-4)
    assert sum(1 for i, t in rows if t and got[i]["evidence"]) >= len(rows) - 2


def test_vocabulary_finds_what_it_holds():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 3000):
        held = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        asked = np.concatenate([held, held ^ 1, rng.integers(-(1 << 63), (1 << 63) - 1, 50)])
        got = toxicity.Vocabulary(held).slots(asked)
        place = {h: i for i, h in enumerate(held.tolist())}
        assert got.tolist() == [place.get(h, n + (h & (toxicity.BUCKETS - 1))) for h in asked.tolist()]


def test_rising_steps():
    import numpy as np

    at, height = toxicity.rising(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert np.all(np.diff(height) >= 0) and np.all(np.diff(at) >= 0) and np.isclose(np.interp(0.3, at, height), 1 / 3)
