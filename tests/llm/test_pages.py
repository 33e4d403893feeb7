import base64
import collections
import hashlib
import io
import zlib

import pytest
from pyarrow import fs

from akzentor.llm import html_extract as hx
from akzentor.llm import warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="home">
<nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav><div class="ad">Buy <b>now</b></div><div id="cookie-notice">We use cookies</div>
<div class="content" id=c%d><h1>Title &amp; more %d</h1><p>First   <b>bo</b>ld&nbsp;text<br>next&#33; N<p>Second &lt;b&gt; paragraph of number %d, which is longer than others are
<ul><li>one of N</li><li>two of N</ul><blockquote>Quoted N</blockquote></div><aside>Side</aside><form><input value=1>Your name</form>
<div class="comments"><p>A reader says %d</p></div><footer>&copy; All <a>rights</a></footer></body></html>"""
TEXT = "Title & more %d\nFirst bold text next! N\nSecond <b> paragraph of number %d, which is longer than others are\none of N\ntwo of N\nQuoted N"


def test_main_text_without_an_article(spark):
    page = lambda i: (PAGE % (i, i, i, i)).replace(" N<", f" {i}<")  # noqa: E731  what all pages have alike would be the template's
    rows = [(i, "http://a.example/%d" % i, page(i)) for i in range(6)] + [(9, "http://b.example/", page(9))]
    got = {r["page_id"]: r for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (*range(6), 9):
        text = (TEXT % (i, i)).replace(" N", f" {i}")
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain & simple", "plain & simple"), ("<article><p>a<p>b</article>", "a\nb"), ("<article><header>H</header><h1>T</h1>x<footer>F</footer></article><p>out", "T\nx"),
        ("<main><p>m</main><p>out", "m"), ("<div role=main>r</div><div>out and much longer than that</div>", "r"), ("<article>a < b &amp;lt; 2 <!-- no --> c</article>", "a < b &lt; 2 c"),
        ("<article><p><b>Bold<br><p>Next</p></article>", "Bold\nNext"), ("<article>x<script>if (a < b) '</p>'</script>y</article>", "xy"), ("<article><script>never closed", ""),
        ("<article><p>a</b>b</p><div class='share buttons'>tweet</div><section id=comments><p>me too</p></section></article>", "ab"), ("<article title='a>b'>q</article>", "q"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"), ("<ARTICLE><P>up</P></ARTICLE>", "up"), ("<article>one</article><article>two</article>", "one\ntwo"),
        ("<article><p hidden>h</p>&#x1F600;&eacute;</article>", "h\n😀é"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"), ("<a 'b <article>z</article>", "z"),
    ],
)
def test_single_pages(page, text):
    assert hx.main_text(page) == text


LEAD, REST = "lead " * 30, "rest " * 70


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class=lead>{LEAD}</div><div class=body>{REST}</div></body>", f"{LEAD.strip()}\n{REST.strip()}"),
        (f"<div class=lead>{LEAD}</div><div class=body>{REST}</div>", f"{LEAD.strip()}\n{REST.strip()}"),
        (f"<body><table><tr><td>short<td>{REST}</table></body>", f"short\n{REST.strip()}"),
        (f"<body><nav>Home</nav><div class=site-footer>All rights</div><div id=x><div>{LEAD}</div><div>{REST}</div></div></body>", f"{LEAD.strip()}\n{REST.strip()}"),
        ("<body><div class='content has-sidebar'><article><p>a</article></div></body>", "a"), ("<body><div class='content no-sidebar'><p>a</p></div></body>", "a"),
        ("<body><div class=widget><main><p>the text<div class=comments>c</div></main></div><p>by X</body>", "the text"),
        ("<body><article>the text<div class=comments><article>a longer comment</article></div></article></body>", "the text"),
        ("<body><main>the text of it<div class=related><article>teaser</article></div></main></body>", "the text of it"),
    ],
)
def test_all_of_the_text_stays(page, text):
    assert hx.main_text(page) == text


def test_a_host_without_an_article_keeps_all_of_the_text(spark):
    page = "<body><div class=top>The same on every page</div><div class=lead>%s</div><div class=body>%s</div></body>"
    rows = [(i, "http://e.example/", page % (f"{i} {LEAD}", f"{i} {REST}")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{i} {LEAD.strip()}\n{i} {REST.strip()}" for i in range(6)}


def test_edge_rows(spark):
    kind = "page_id long, url string, html string, host string, text string, slot long"
    rows = [(1, None, None, "h", "t", 1), (2, "", "", None, None, None), (None, "nonsense", "<article>x</article>", "h", "t", 1), (3, "http://h/", "<article>" + "w " * 300_000 + "</article>", "h", "t", 1), (4, "http://H/", "<p>same", "h", "t", 1), (4, "http://h:80/", "<p>same", "h", "t", 1)]
    got = hx.extract(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 599_999), (4, 4), (4, 4)] and hx.extract(spark.createDataFrame(rows, kind)).columns == ["page_id", "url", "text", "n_chars"]
    assert hx.extract(spark.createDataFrame([], kind)).collect() == []


def test_classes_are_those_of_equal_occurrence_vectors(spark):
    pages = [(i, "http://a.example/", PAGE % (i, i, i, i) if i % 3 else "<html><body><div id=z>%d</div><p>fixed" % i) for i in range(9)]
    got = hx.deduce_templates(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    vector = collections.defaultdict(dict)
    for i, _, h in pages:
        for t in hx.page_tokens(h):
            vector[t[0]][i] = t[3]
    kinds = {t[0]: t[2] for _, _, h in pages for t in hx.page_tokens(h)}
    least = lambda t: max(hx.LEAST_PAGES, 9 * hx.SUPPORT * (hx.SHARE if kinds[t] == "" else 1))
    valid = {t: tuple(sorted(v.items())) for t, v in vector.items() if len(v) >= least(t)}
    assert {r["token"] for r in got} == set(valid)
    for a in got:
        for b in got:
            assert (a["class"] == b["class"]) == (valid[a["token"]] == valid[b["token"]])


def test_a_notice_of_the_template_goes_and_an_article_stays(spark):
    page = "<html><body><div><p>Please read our rules before you write.</p><p>%s</p></div></body></html>"
    rows = [(i, "http://c.example/", page % (f"Page {i} tells of " + "many things " * 20)) for i in range(5)]
    rows += [(10 + i, "http://d.example/", "<article><p>the same article on every page</article>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"Page {i}") and "rules" not in got[i] for i in range(5))
    assert all(got[10 + i] == "the same article on every page" for i in range(5))


ROWS = [(5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, None), (4, "u", ""), (7, "u", "größe 😀\r\n\r\nWARC/1.1\r\n"), (8, "u", "same"), (8, "u", "same"), (2, "u", "same"), (None, "u", "same"), (11, "u", "x" * 700_000)]


def expected(rows, least):
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        again = k is not None and len(p) >= least and first[h or ""] != k
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, tmp_path, least):
    pages = spark.createDataFrame([(*r, "h", 1) for r in ROWS], "page_id long, url string, html string, hex string, refers_to long")
    path = f"file://{tmp_path}/a"
    assert warc.write_archives(pages, path, least).agg({"records": "sum"}).first()[0] == len(ROWS)
    warc.register(spark)
    for verify in ("true", "false"):
        got = spark.read.format("warc").option("verify", verify).load(path).collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["warc_type"], r["refers_to"]) for r in got), key=repr) == expected(ROWS, least)
    payload = {r["page_id"]: bytes(r["payload"]) for r in got if r["warc_type"] == "response" and r["page_id"]}
    assert payload[7] == "größe 😀\r\n\r\nWARC/1.1\r\n".encode() and payload[11] == b"x" * 700_000 and payload[4] == b""
    assert all(r["payload"] is None for r in got if r["warc_type"] == "revisit")


def test_filters_are_taken_over_and_right(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = f"file://{tmp_path}/b"
    warc.write_archives(pages, path).collect()
    warc.register(spark)
    data = spark.read.format("warc").load(path)
    every = data.collect()
    for text, test in (
        ("warc_type = 'revisit'", lambda r: r["warc_type"] == "revisit"), ("page_id = 8", lambda r: r["page_id"] == 8), ("page_id in (5, 8)", lambda r: r["page_id"] in (5, 8)), ("refers_to is not null", lambda r: r["refers_to"] is not None),
        ("target_uri like 'http%'", lambda r: (r["target_uri"] or "").startswith("http")), ("payload_bytes > 5", lambda r: r["payload_bytes"] > 5), ("warc_type = 'response' and page_id > 6", lambda r: r["warc_type"] == "response" and (r["page_id"] or 0) > 6), ("page_id is null", lambda r: r["page_id"] is None),
    ):
        assert data.filter(text).count() == sum(map(test, every)), text
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f) for f in reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("payload_bytes",), 5)])] == [GreaterThan]
    assert len(reader.partitions()) >= 1


def test_what_is_skipped_is_not_inflated():
    """Records that a filter rules out, or whose payload nobody wants, cost a look at their headers."""
    big = bytes(range(256)) * 4000
    parts = [warc.record(i, f"http://u/{i}", big, warc.base32_sha1(big), None if i == 0 else 0, "http://u/0") if i < 3 else warc.record(i, "u", b"%d" % i + big, warc.base32_sha1(b"%d" % i + big)) for i in range(9)]
    data = b"".join(map(warc.member, parts))
    for wanted, payload, verify, keys, most in (
        ([("warc_type", "eq", "revisit")], True, True, [1, 2], 9 * 2048), ([], False, False, list(range(9)), 9 * 2048), ([("page_id", "eq", "4")], True, False, [4], 9 * 2048 + len(parts[4]) + (1 << 18)), ([], True, False, list(range(9)), 9 * len(parts[8])),
    ):
        stream = warc._Stream(io.BytesIO(data))
        rows = list(warc._records(stream, "f", wanted, payload, verify))
        assert [r[8] for r in rows] == keys and stream.inflated <= most
        assert all(r[10] == len(big) + (r[8] > 2) for r in rows)
    first, again = (next(iter(warc.read_records(io.BytesIO(warc.member(p)), "f", [], True, True))) for p in parts[:2])
    assert again[5] == first[2] and again[4] == first[3] == "http://u/0"
    import gzip

    assert gzip.decompress(data) == b"".join(parts)


def test_other_writers_archives(tmp_path):
    """Plain and whole-gzipped files, records without HTTP, unknown headers, a cut file."""
    block = b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 4\r\nX-Other: 1\r\n\r\nabcd\r\n\r\n" + warc.record(3, "u", b"pay", warc.base32_sha1(b"pay"))
    for data in (block, zlib.compress(block, wbits=31), warc.member(block[:80]) + warc.member(block[80:])):
        rows = list(warc.read_records(io.BytesIO(data), "f", [], True, True))
        assert [(r[1], r[10], r[11]) for r in rows] == [("warcinfo", 4, b"abcd"), ("response", 3, b"pay")]
        assert [r[8] for r in warc.read_records(io.BytesIO(data), "f", [("warc_type", "eq", "response")], False, False)] == [3]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(block[:-8]), "f", [], True, False))
    wrong = warc.record(3, "u", b"pay", warc.base32_sha1(b"other"))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(wrong), "f", [], False, True))
    assert fs is not None and list(warc.read_records(io.BytesIO(b""), "f", [], True, True)) == []


def test_write_and_read_nothing(spark):
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def words(i, n, k=0):
    return " ".join(f"word{(i * 31 + j * 7 + k) % 97}" for j in range(n))


def hosts_of_eight():
    """Five hosts of eight pages each without telling names, and the main text of each page."""
    rows, want = [], {}

    def add(host, i, page, text):
        rows.append((len(rows), f"http://{host}.example/{i}", page))
        want[len(rows) - 1] = text

    for i in range(8):
        menu = "".join(f"<li><a href=/{x}>{x}</a>" for x in (("Home", "News", "Shop") if i % 2 else ("Start", "Blog", "Contact")))
        p = [words(i, 20 + 3 * i, k) for k in range(2 + i % 3)]
        body = "".join(f"<p>{x}</p>" for x in p)
        text = "\n".join(p)
        remarks = "".join(f"<div class=r4><span>reader {i} {j}</span><p>{words(i, 6, j + 50)}</p></div>" for j in range(i % 4))
        # Lines of the template within an article and before it; a menu in two variants.
        add("a", i, f"<body><div class=k1><ul>{menu}</ul></div><article>{body}<div class=q7>Follow our channel for updates</div></article></body>", text)
        # No article: a closing line in a plain paragraph is the text's own, remarks after it aren't.
        add("b", i, f"<body><div class=k1><ul>{menu}</ul></div><div class=za>{body}<p>Written with care.</p></div><div class=zb>{remarks}</div><div class=zc>All about us</div></body>", f"{text}\nWritten with care.")
        # The page stands in a form; a search form doesn't matter.
        add("c", i, f"<body><form><div class=k1>Ask here</div><div class=za>{body}</div><input value=x><button>Send</button></form></body>", text)
        # Formulas, sections and warnings of the article.
        add("d", i, f"<body><form>Search all<input></form><article><h1>Title {i}</h1><p>if <math><mi>x</mi><mo>=</mo><mn>{i}</mn></math> then</p><div class=warning>Take care {i}</div><section class=related-work>{body}</section></article></body>", f"Title {i}\nif x={i} then\nTake care {i}\n{text}")
        # Copies of one article show no template.
        add("e", i, "<body><div class=t>Title</div><div class=za><p>" + words(1, 40) + "</p></div></body>", "Title\n" + words(1, 40))
    return rows, want


def test_hosts_by_their_template(spark):
    rows, want = hosts_of_eight()
    got = {r["page_id"]: r["text"] for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in want.items():
        assert got[k] == text, (rows[k], got[k])


def plain_parts(pages):
    """`template_parts` of one host told plainly, over whole occurrence vectors held in memory."""
    n, vector, info = len(pages), collections.defaultdict(lambda: [0] * len(pages)), {}
    for i, h in enumerate(pages):
        for token, parent, kind, count, place, text, main in hx.page_tokens(h):
            vector[token][i] = count
            old = info.get(token, (parent, kind, 0, main))
            info[token] = (parent, kind, old[2] + text, max(old[3], main))
    on = {t: sum(map(bool, v)) for t, v in vector.items()}
    elements = {t for t in vector if info[t][1] not in ("", "=") and on[t] >= max(2, n * hx.SUPPORT)}
    same = {t: [on[c] for c in vector if info[c][1] == "" and info[c][0] == t and on[c] >= max(2, on[t] * hx.SHARE, n * hx.SUPPORT * hx.SHARE)] for t in elements}
    cover = {t: sum(same[t]) / on[t] for t in elements}
    most = max(info[t][2] for t in elements)
    mains = [cover[t] for t in elements if info[t][3] > 0]
    if cover[next(t for t in elements if info[t][1] == "body")] >= hx.COPIES or max(mains, default=0) >= hx.COPIES:
        return None
    once = {t for t in elements if max(vector[t]) == 1}
    fixed = {t for t in once if (info[t][3] == 0 and cover[t] >= hx.COVER and 2 * info[t][2] <= most) or (info[t][3] < 0 and max(same[t], default=0) >= max(hx.LEAST_SAME, on[t] * hx.COVER))}
    records = {t for t in elements - once if info[t][3] == 0 and info[t][1] in hx.RECORDS and any(info[c][0] == t and vector[c] == vector[t] for c in elements)}
    return fixed, records, {t for t in once if info[t][3] > 0}


def test_template_against_plain_vectors(spark):
    rows, _ = hosts_of_eight()
    got = {r["host"]: r for r in hx.template_parts(hx.deduce_templates(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    for host in "abcde":
        want = plain_parts([h for _, u, h in rows if f"//{host}." in u])
        if want is None:
            assert f"{host}.example" not in got and host == "e"
            continue
        own = got[f"{host}.example"]
        assert set(own["fixed"]) == want[0] and set(own["records"] or ()) == want[1] and ({own["slot"]} if own["slot"] else set()) == want[2]
    assert got["b.example"]["records"] and got["a.example"]["fixed"]


def test_a_very_long_page_on_a_host_with_a_template(spark):
    rows = [(i, "http://l.example/", f"<body><div class=m>Menu</div><article><p>{words(i, 30)}</p><p>" + ("long " * 200_000 if i == 3 else "x") + "</p></article>") for i in range(5)]
    got = {r["page_id"]: r for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["n_chars"] > 999_000 and got[2]["text"] == words(2, 30) + "\nx"
