"""Main text of pages, and WARC archives with damage."""

import base64
import hashlib
import random

from fieldmerge.llm import htmltext, warc
from fieldmerge.llm.queries import op8_warc

PARAGRAPH = "This is a sentence of the article, with some commas, and a full stop. "


def page(article, wrap="article", before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a></li></ul></nav>{before}<{wrap}>{article}</{wrap.split()[0]}>{after}<footer>&copy; all</footer></body></html>"


def test_article_alone():
    for wrap in ("article", "main", "div class=content", "div"):
        html = page(f"<h1>Head &amp; line</h1><p>{PARAGRAPH * 3}<br>short<p><b>bold</b>ness  and\n <i>it</i>alic</p><p>{PARAGRAPH * 2}", wrap, "<div class='ad'>Buy, now. Really.</div><div id='cookie-notice'>We use cookies, all of them.</div>", "<aside>More, and more.</aside><div class='comments'><p>First! I disagree, strongly, with all of it.</p></div><form>Search <input></form>")
        assert htmltext.main_text(html) == f"Head & line {(PARAGRAPH * 3).strip()} short boldness and italic {(PARAGRAPH * 2).strip()}", wrap


def test_odd_pages(spark):
    long = PARAGRAPH * 20_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text &lt;here&gt;  a < b"), (4, "u", "<p>open <b>bold"), (5, "u", "<nav>only a menu</nav><script>x"), (6, "u", page(f"<p>{long}</p>")), (None, "u", "<p>x</p>"), (6, "u", "<!-- <p>no</p> --><p title='a>b'>yes</p>")]
    out = htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text")).collect()
    texts = sorted((str(r["page_id"]), r["text"]) for r in out)
    assert texts == sorted([("1", ""), ("2", ""), ("3", "just text <here> a < b"), ("4", "open bold"), ("5", ""), ("6", long.strip()), ("None", "x"), ("6", "yes")])
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert htmltext.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_salvage_finds_what_follows_damage():
    records = [warc.record(i, f"http://x/{i}", b"page %d " % i * 50, warc.payload_digest(b"page %d " % i * 50), None) for i in range(6)]
    plain = __import__("zlib").decompress(records[5], 31)
    broken = bytearray(records[1])
    broken[len(broken) // 2] ^= 0xFF
    wrong = plain.replace(b"page 5", b"page X", 1)
    data = b"noise" + records[0] + bytes(broken) + records[2] + records[3][:-20] + plain + wrong + records[4][:30]
    found = list(warc.salvage(data))
    ids = [f[3]["warc-record-id"] for f in found if f[0] == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 2, 5)]
    covered = sorted((f[1], f[2]) for f in found)
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    assert [f[1:3] for f in found if f[0] == "gap"][0] == (0, 5) and all(f[5] for f in found if f[0] == "gap")
    assert list(warc.salvage(b"")) == [] and [f[0] for f in warc.salvage(b"\x1f\x8b\x08")] == ["gap"]


def test_round_trip(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 70_000, "<p>b</p>\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "c"]
    rows = [(i if i != 7 else None, None if i == 2 else f"http://x/{i}", t, "clash") for i, t in enumerate(html)] + [(0, "http://x/0", "<p>a</p>", "clash")]
    spark.createDataFrame(rows, "page_id long, url string, html string, hash string").write.parquet(f"{tmp_path}/pages.parquet")
    out = op8_warc(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        payload = (next(h for i, _, h, _ in rows if i == r["page_id"]) or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        first = {3: 0, 6: 0, 2: 1}.get(r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first is None else ("revisit", first))
    archives = warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), least_revisit=10)
    assert warc.gaps(archives).count() == 0
    assert sorted(str(r["refers_to"]) for r in warc.pages_read(archives).collect()) == ["None"] * 9
    path = tmp_path / "one.warc.gz"
    path.write_bytes(archives.first()["data"] + b"tail")
    read = warc.read_archives(spark, str(path))
    assert warc.gaps(read).first()["n_bytes"] == 4
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_line_separators_in_urls_and_folded_headers():
    for c in "\x85  ":
        found = list(warc.salvage(warc.record(1, f"http://x/a{c}b", b"p", warc.payload_digest(b"p"), None)))
        assert [f[0] for f in found] == ["record"] and found[0][3]["warc-target-uri"] == f"http://x/a{__import__('urllib.parse').parse.quote(c)}b"
        other = f"WARC/1.0\r\nWARC-Type: resource\r\nX-Note: a{c}b\r\n  and\r\n\tmore\r\nContent-Length: 1\r\n\r\np\r\n\r\n".encode()
        found = list(warc.salvage(other))
        assert [f[0] for f in found] == ["record"] and found[0][3]["x-note"] == f"a{c}b and more"


def test_records_before_damage_in_a_member():
    import random
    import zlib

    payloads = [random.Random(i).randbytes(3000) for i in range(5)]
    plain = b"".join(zlib.decompress(warc.record(i, f"http://x/{i}", p, warc.payload_digest(p), None), 31) for i, p in enumerate(payloads))
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    member = packer.compress(plain) + packer.flush()
    broken = bytearray(member)
    broken[-1] ^= 0xFF
    after = warc.record(9, "http://x/9", b"p", warc.payload_digest(b"p"), None)
    for data, ids in ((member[: len(member) * 7 // 10], [0, 1, 2]), (member[: len(member) * 7 // 10] + after, [0, 1, 2, 9]), (bytes(broken), [0, 1, 2, 3])):
        found = list(warc.salvage(data))
        assert [f[3]["warc-record-id"] for f in found if f[0] == "record"] == [f"<urn:page:{i}>" for i in ids]
        assert [f[0] for f in found].count("gap") == 1


def test_wrappers_that_only_name_something_else():
    body = f"<h1>Title</h1><p>{PARAGRAPH * 3}</p><p>{PARAGRAPH * 2}</p>"
    text = f"Title {(PARAGRAPH * 3).strip()} {(PARAGRAPH * 2).strip()}"
    inner = f"<article>{body}</article>"
    comments = f"<div id=comments><article class=comment><p>{PARAGRAPH * 9}</p></article></div>"
    related = "<div class=related-posts><article><p>Another story, in short.</p></article></div>"
    for wrap in ("form id=aspnetForm", "div class='content with-sidebar'", "div class=has-sidebar", "div class=no-header", "div class='elementor-widget-text'"):
        for html in (inner, body, inner + "<div class=sidebar><p>Aside, from it.</p></div>", inner + comments, inner + related, body + comments):
            assert htmltext.main_text(page(html, wrap)) == text, (wrap, html[:20])
        assert htmltext.main_text(page(inner, wrap, after=comments)) == text, wrap
    for head in ("post-header", "entry-header"):
        split = f"<div class={head}><h1>Title</h1><p>By me, today.</p></div><div class=text>{body[14:]}</div>"
        assert htmltext.main_text(page(split)) == htmltext.main_text(page(split, "div")) == text, head
    assert htmltext.main_text(page(body[14:], "div", "<div class=site-header><h1>Site</h1></div>")) == text[6:]
    assert htmltext.main_text(page("<h1>Title</h1><p>Short.</p>", before=f"<div class=ad>{PARAGRAPH * 3}</div>")) == "Title Short."


LONG = "Ein langer Absatz, der etwas sagt: viel, wenig, nichts. Und noch ein Satz, damit er lang genug ist; so ist es. " * 3


def plain(path, *texts):
    """Text within elements without names: the path's tags, each text in the last of them."""
    tags = path.split()
    return "".join(f"<{t}>" for t in tags[:-1]) + "".join(f"<{tags[-1]}>{x}</{tags[-1]}>" for x in texts) + "".join(f"</{t}>" for t in reversed(tags[:-1]))


def test_ratios_decide_without_names(monkeypatch):
    """No article, no main, no class: only the ratios tell the content from what is around it."""
    page = "<body>" + plain("div ul li", *(f"Entry number {i}" for i in range(60))) + "<div><section><h1>Title</h1>" + "".join(f"<p>{LONG}{i}.</p>" for i in range(4)) + "</section></div>" + plain("div div span", "Impressum") + plain("section ul li", "One", "Two") + "</body>"
    expected = " ".join(["Title", *(f"{LONG}{i}." for i in range(4))])
    assert htmltext.main_text(page) == expected
    monkeypatch.setattr(htmltext, "content_paths", lambda kept: [p for p, _ in kept])  # no threshold
    assert htmltext.main_text(page) != expected


def test_short_parts_of_an_article_stay():
    """Whatever its size, a part of the article that doesn't mark itself as something else is text of it."""
    whole = LONG.strip()
    for part, said in (
        ("<table><tr><td>1<td>2</table>", "1 2"), ("<div class=highlight><pre>x = 1</pre></div>", "x = 1"), ("<section><p>Thanks.</p></section>", "Thanks."), ("<div>" + plain("ul li", "One", "Two") + "</div>", "One Two"),
        (f'<section class="social history"><p>{LONG}</p></section>', whole), (f"<section class=related-work><p>{LONG}</p></section>", whole), (f"<div class=notice-of-death><p>{LONG}</p></div>", whole),
        ("<div class=related><p>More, of it.</p></div>", ""), ("<div class=related-posts><p>" + LONG + "</p></div>", ""), (f"<div class=feedback><p>{LONG}</p></div>", ""), ("<div class=social>Share</div>", ""), (f"<div class='ad box'>{LONG}</div>", ""),
    ):
        for before in (1, 6):
            html = f"<body><article><h1>T</h1>{f'<p>{LONG}</p>' * before}{part}<p>{LONG}</p></article></body>"
            assert htmltext.main_text(html) == " ".join(["T", *[whole] * before, *([said] if said else []), whole]), part


def test_single_article_beside_more_text():
    for name in ("user-posts", "wall", "stream"):
        page = f"<body><article><h1>T</h1><p>Short story, told.</p></article><section class={name}><p>{LONG}</p><p>{LONG}</p></section></body>"
        assert htmltext.main_text(page) == "T Short story, told.", name


def test_deep_and_broken_nesting():
    import time

    for unit in ("<div><p>y", "<div class=ad><p>y", "<blockquote><p>y", "<main><p>y", "</b></div></p>", "<li>x", "<table><tr><td>z", "<article>t", "<form><div class=related>r"):
        start = time.time()
        htmltext.main_text(unit * 20_000)
        assert time.time() - start < 8, unit
    assert htmltext.main_text("<div>" * 5000 + f"<p>{LONG}") == LONG.strip()


def generated(rnd):
    """A page with the text of its article, told while it is made."""
    words = "amo bene casa dies ergo fama gens homo ille jam lex mons nox opus pax quod res sol tempus urbs via".split()
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + rnd.choice(",;") + " " + " ".join(rnd.choice(words) for _ in range(n)) + "."
    said, parts = [], []

    def add(markup, *texts):
        said.extend(texts)
        parts.append(markup)

    title = sentence(2)
    add(f"<h1>{title}</h1>", title)
    for _ in range(rnd.randint(3, 9)):
        kind, text = rnd.random(), " ".join(sentence(rnd.randint(4, 9)) for _ in range(rnd.randint(2, 5)))
        if kind < 0.6:
            add(f"<p>{text}</p>", text)
        elif kind < 0.7:
            add(f"<section class='{rnd.choice(['part', 'note x', 'history'])}'><h2>On &amp; on</h2><p>{text}</section>", "On & on", text)
        elif kind < 0.8:
            add("<ul><li>Salt<li>Oil &lt;2</ul>", "Salt", "Oil <2")
        elif kind < 0.9:
            add(f"<blockquote><p>{text}</blockquote><pre>a\n  b</pre>", text, "a b")
        else:
            add(rnd.choice(["<div class=ad>Buy it, now.</div>", "<script>var p='<p>no</p>'</script>", "<aside><p>By the way, no.</p></aside>", "<div class=share>Send, post</div>", "<!-- <p>no</p> -->", "<form>Search <input></form>"]))
    around = ["<nav><ul><li><a>Home</a><li><a>Out</a></ul></nav>", "<div class=sidebar><p>Aside, and so on.</p></div>", "<div id=cookie-notice>We use cookies, all of them.</div>", "<div class=banner>Sale! Now, here.</div>"]
    rnd.shuffle(around)
    comments = f"<section class=comments>{''.join(f'<div class=comment><p>{sentence(8)} {sentence(7)}</p></div>' for _ in range(rnd.randint(0, 8)))}</section>"
    cut = rnd.randint(0, len(around))
    wrap = rnd.choice(["article", "main", "div class=content", "div id=x"])
    inner = "".join(parts) + (comments if rnd.random() < 0.5 else "")
    html = f"<!DOCTYPE html><html><head><title>T</title></head><body><header><a>Site</a></header>{''.join(around[:cut])}<{wrap}>{inner}</{wrap.split()[0]}>{''.join(around[cut:])}{comments}<footer>All rights, always.</footer></body></html>"
    return html, " ".join(said)


def test_generated_pages():
    rnd = random.Random(8)
    for _ in range(400):
        html, expected = generated(rnd)
        assert htmltext.main_text(html) == expected, html


def test_content_paths_against_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        paths = [tuple(rnd.choice(["div", "p", "li", "td"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 6))]
        kept = [(rnd.choice(paths), "".join(rnd.choice("abc,. ") for _ in range(rnd.randint(1, 80)))) for _ in range(rnd.randint(1, 30))]
        order = list(dict.fromkeys(p for p, _ in kept))
        texts = {p: [t for q, t in kept if q == p] for p in order}
        length = [sum(map(len, texts[p])) / len(texts[p]) for p in order]
        marks = [sum(t.count(",") + t.count(".") for t in texts[p]) / len(texts[p]) for p in order]
        around = lambda x, i: 0.25 * x[max(i - 1, 0)] + 0.5 * x[i] + 0.25 * x[min(i + 1, len(x) - 1)]
        whole = sum(len(t) for _, t in kept)
        fused = [around(length, i) * (1 + around(marks, i)) * sum(map(len, texts[p])) / whole for i, p in enumerate(order)]
        mean = sum(fused) / len(fused)
        cut = min(0.5 * (sum((f - mean) ** 2 for f in fused) / len(fused)) ** 0.5, max(fused))
        if min(abs(f - cut) for f in fused) > 1e-9:
            assert htmltext.content_paths(kept) == [p for p, f in zip(order, fused, strict=True) if f >= cut]


def test_wrappers_with_telling_names():
    body = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    for page in (f'<div class="layout with-sidebar"><article>{body}</article></div>', f'<div class="no-comments">{body}</div>', f'<div class="post"><div class="post-header"><h1>Title</h1></div><p>{LONG}</p><p>{LONG}</p></div>'):
        assert htmltext.main_text(f"<body>{page}</body>") == f"Title {LONG}{LONG}".strip()


def test_records_with_line_feeds_only():
    def plain_record(name, block, end):
        head = end.join(["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <{name}>", f"Content-Length: {len(block)}"])
        return (head + 2 * end).encode() + block + (2 * end).encode()

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    data = plain_record("a", http, "\n") + plain_record("b", http, "\n") + plain_record("c", http, "\r\n")
    found = list(warc.salvage(data))
    assert [(k, h.get("warc-record-id"), b) for k, _, _, h, b, _ in found] == [("record", f"<{n}>", http) for n in "abc"]


def test_false_starts_take_linear_time():
    import time

    rnd = random.Random(2)
    good = warc.record(7, "http://x/7", b"p" * 500, warc.payload_digest(b"p" * 500), None)
    for junk in (b"\x1f\x8b\x08" * 100_000, b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x00" * 20_000, b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\x00\xff\xff" * 10_000, b"\x1f\x8b\x08" + rnd.randbytes(1_000_000), b"".join(b"\x1f\x8b\x08\x00" + rnd.randbytes(8) for _ in range(10_000)), b"WARC/1.0\r\n" * 30_000):
        start = time.time()
        found = list(warc.salvage(good + junk + good))
        assert time.time() - start < 20, junk[:12]
        assert [f[3]["warc-record-id"] for f in found if f[0] == "record"] == ["<urn:page:7>"] * 2
        assert [(f[1], f[2]) for f in found if f[0] == "gap"][0][0] == len(good) and found[-1][2] == len(good + junk + good)


def test_joined_payloads_as_sent_ones(spark, monkeypatch):
    rows = [(i, f"u{i}", f"<p>{i % 3}</p>") for i in range(12)] + [(None, "u", "<p>1</p>"), (None, "v", "x"), (None, "w", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sent = sorted(warc.pages_read(warc.write_archives(pages)).collect(), key=str)
    monkeypatch.setattr(warc, "MOST_SENT", 0)
    assert sorted(warc.pages_read(warc.write_archives(pages)).collect(), key=str) == sent
