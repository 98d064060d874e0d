"""Pages, archives, chats and audio: round trips and plain versions."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocktake.llm import chat, htmltree, telephony, warc


def test_adpcm_equals_one_sample_at_a_time():
    data = np.random.default_rng(4).integers(0, 256, 4 * 36 + 20, np.uint8).tobytes()
    want = []
    for at in range(0, len(data), 36):
        block = data[at : at + 36]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        want.append(value)
        for nibble in (n for b in block[4:] for n in (b & 15, b >> 4)):
            step = int(telephony.IMA_STEP[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if nibble & bit else 0
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(telephony.IMA_INDEX[nibble])))
            want.append(value)
    assert telephony.decode_adpcm(data, 36).tolist() == want


def test_companding_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_clip(media):
    """Samples at twice the rate and their features, without tables, blocks or
    slices."""
    tag, rate, block, data = telephony.parse_wave(media)
    if tag == telephony.MULAW:
        samples = []
        for b in data:
            b = ~b & 255
            size = ((((b & 15) << 3) + 132) << (b >> 4 & 7)) - 132
            samples.append(-size if b & 128 else size)
    elif tag == telephony.ALAW:
        samples = []
        for b in data:
            b ^= 0x55
            size, e = (b & 15) << 4, b >> 4 & 7
            size = size + 8 if e == 0 else (size + 264) << (e - 1)
            samples.append(size if b & 128 else -size)
    else:
        samples = telephony.decode_adpcm(data, block).tolist()
    last = len(samples) - 1
    out = [int(np.rint((samples[i // 2] + samples[min(last, (i + 1) // 2)]) / 2)) for i in range(2 * len(samples))]
    x = np.array(out, np.float64)
    frames = np.concatenate([x, np.zeros(-len(x) % 256)]).astype(np.float32).reshape(-1, 256)
    bands = (np.abs(np.fft.rfft(frames, axis=1)[:, 1:]) ** 2).sum(axis=0).reshape(8, 16).sum(axis=1)
    share = bands / bands.sum() if bands.sum() else bands
    crossings = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:], strict=False))
    return out, f"ms={len(out) * 1000 // (2 * rate)};rms={np.sqrt(np.mean(x**2)):.1f};peak={int(np.abs(x).max())};zc={crossings};bands=" + ",".join(f"{v:.3f}" for v in share)


def test_long_clips_in_stretches(monkeypatch):
    r = np.random.default_rng(3)
    clip = telephony.wave(r.integers(0, 256, 64 * 400, np.uint8).tobytes(), telephony.MULAW, 8000, 8, 1)
    monkeypatch.setattr(telephony, "STEP", 1024)
    samples, rate = telephony.decode(clip)
    out = telephony.resample(samples, rate, 16_000)
    assert out.tolist() == plain_clip(clip)[0]
    assert telephony.features(out, 16_000) == plain_clip(clip)[1]


def test_audio_round_trip(spark, awkward, nothing):
    clips = telephony.store_clips(awkward)
    found = telephony.describe(clips).collect()
    assert len(found) == 10
    want = {}
    for r in awkward.collect():
        raw = (r.text or "").encode("utf-8", "surrogatepass")
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.setdefault(r.doc_id, set()).add((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in found:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
    stored = {bytes(x.media) for x in clips.collect()}
    assert {telephony.parse_wave(m)[0] for m in stored} == {telephony.ALAW, telephony.MULAW, telephony.IMA_ADPCM}
    plain = {hashlib.sha256(m).hexdigest(): plain_clip(m) for m in stored}
    for r in found:
        samples, text = plain[r.media_sha256]
        assert telephony.parse_wave(bytes(r.pcm))[3] == np.array(samples, "<i2").tobytes()
        assert r.feature == text
    pcm = telephony.resampled_pcm(clips).where("doc_id = 1").first().media
    assert telephony.parse_wave(bytes(pcm))[:2] == (telephony.PCM, telephony.RESAMPLED)
    assert telephony.describe(telephony.store_clips(nothing)).count() == 0


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = ["### ", "</turn>", "\\", "#", "##", ": ", "\n", "a", "<\\/turn>", " ", "Assistant", "\\#", ":\\/ "]
    rows = [(i // 4, i % 4, r.choice(["user", "assistant", "sys: tem", "a\\b", "###"]), "".join(r.choices(bits, k=r.randint(0, 9)))) for i in range(400)] + [(500, 0, None, None), (500, 0, None, None), (None, None, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_turns(chat.format_turns(table)).collect()
    plain = lambda a, b, c, d: (str(a), str(b), c or "", d or "")
    assert sorted(plain(x.conv_id, x.turn, x.role, x.text) for x in back) == sorted(plain(*x) for x in rows)
    for x in back:
        assert x.loss_text == (x.text if x.role == "assistant" else "")
    assert chat.digests(chat.read_turns(chat.format_turns(table.limit(0)))).count() == 0
    # whole conversations, parsed from their text alone
    whole = chat.turns_of(chat.conversations_of(chat.format_turns(table))).orderBy("conv_id", "place").collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(x.conv_id, x.role, x.text) for x in whole] == [(c, r or "", t or "") for c, _, r, t in order]


def test_chat_clashing_and_repeated_rows(spark):
    rows = [(1, 0, "user", "a", 1, "x", 0), (1, 0, "user", "a", 1, "x", 0), (1, 1, "assistant", "### b", 2, "y", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int, formatted string, loss_start int")
    found = chat.digests(chat.read_turns(chat.format_turns(table))).first()
    assert found.n_turns == 3 and found.loss_chars == 5


def test_revisits_equal_a_plain_search(spark):
    r = random.Random(8)
    urls = ["http://A.example/x/", "https://www.a.example/x", "a.example:80/x?utm_source=1", "b.example/y", None]
    rows = [(f"k{i:03}", r.choice(urls), r.choice([None, *range(40)]), r.choice(["response", "revisit", "other"]), {"etag": r.choice(['"1"', 'W/"1"', '"2"'])}) for i in range(300)]
    table = spark.createDataFrame(rows, "record_id string, url string, captured long, kind string, headers map<string,string>")
    canonical = {"b.example/y": "b.example/y", None: None} | dict.fromkeys(urls[:3], "a.example/x")
    full = [(t, k, canonical[u], h) for k, u, t, kind, h in rows if kind == "response" and t is not None and u]
    for x in warc.resolve_revisits(table, buckets=4).collect():
        earlier = [y for y in full if x.canonical == y[2] and x.captured is not None and y[0] < x.captured]
        best = max(earlier, default=None, key=lambda y: y[:2])
        assert x.response_id == (best[1] if best else None)
        tag = next(h["etag"] for k, *_, h in rows if k == x.record_id)
        same = best and tag.removeprefix("W/") == best[3]["etag"].removeprefix("W/")
        assert x.status == ("no-response" if not best else "resolved" if same else "validator-mismatch")
    assert warc.resolve_revisits(table.limit(0)).count() == 0


def test_revisits_with_repeated_rows_hot_times_and_other_columns(spark):
    """One URL with an outlier in time, and many moments at one place."""
    r = random.Random(2)
    times = [-(10**9)] + [r.randint(0, 5000) for _ in range(900)]
    rows = [(f"k{i:04}", "hot.example/a", t, "response" if i % 3 == 0 else "revisit", {"etag": '"1"'}) for i, t in enumerate(times)]
    rows += [(f"s{i}", f"u{i}.example", i, "response", {"etag": '"1"'}) for i in range(9)] + [("q1", "u3.example", 7, "revisit", {"etag": '"1"'})] * 3
    rows += rows[:60]
    table = spark.createDataFrame(rows, "record_id string, url string, captured long, kind string, headers map<string,string>").selectExpr("*", "1 AS canonical", "2 AS bucket", "3 AS response_id", "4 AS status", "5 AS found", "6 AS answer")
    found = warc.resolve_revisits(table, buckets=8, hot=50).collect()
    asked = [x for x in rows if x[3] == "revisit"]
    assert sorted(x.record_id for x in found) == sorted(x[0] for x in asked)
    full = [(t, k) for k, u, t, kind, _ in rows if kind == "response" and u == "hot.example/a"]
    for x in found:
        if x.record_id == "q1":
            assert x.response_id == "s3"
        else:
            assert x.response_id == max((y for y in full if y[0] < x.captured), default=(0, None))[1]
    moments = warc._bucketed(table.select("record_id", F.col("url").alias("canonical"), "captured").distinct(), 8, 50)
    sizes = [n["count"] for n in moments[0].where("canonical = 'hot.example/a'").groupBy("bucket").count().collect()]
    assert moments[1] and len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def tree_marginals(model, nodes, own):
    """Marginals by listing all labellings of a small tree."""
    from itertools import product

    scores = []
    for labels in product((0, 1), repeat=len(nodes)):
        total = sum(sum(model.unary[f] for f in own[i]) for i, x in enumerate(labels) if x)
        for i, node in enumerate(nodes):
            if node.parent >= 0:
                total += model.edge[htmltree._edge(node, nodes[node.parent])].reshape(2, 2)[labels[node.parent], labels[i]]
        scores.append((labels, np.exp(total)))
    z = sum(s for _, s in scores)
    return [sum(s for labels, s in scores if labels[i]) / z for i in range(len(nodes))]


def test_marginals_equal_all_labellings():
    model = htmltree.default_model()
    nodes = htmltree.parse("<body><nav><a>Home</a></nav><article><p>Some words here.</p></article></body>")
    own = [htmltree.features(x) for x in nodes]
    assert len(nodes) < 14
    found = model.marginals(nodes, own)[0]
    assert np.allclose(found, tree_marginals(model, nodes, own), atol=1e-6)


@pytest.mark.parametrize("layout", htmltree.LAYOUTS)
def test_held_out_pages_by_layout(layout):
    model = htmltree.default_model()
    right = wrong = lost = 0
    for page in htmltree.labelled_pages(40, 1234, layout):
        nodes = htmltree.parse(page)
        content, _ = model.marginals(nodes, [htmltree.features(x) for x in nodes])
        for node, p in zip(nodes, content, strict=True):
            if node.tag == "#text":
                right += bool(node.label) and p >= 0.5
                wrong += not node.label and p >= 0.5
                lost += bool(node.label) and p < 0.5
    assert right / (right + wrong) > 0.97 and right / (right + lost) > 0.95


def test_ordinary_layouts_keep_their_article():
    model, text = htmltree.default_model(), "Some words of an ordinary sentence that goes on for about a hundred letters and then comes to an end."
    menu, foot = "<ul class='nav'><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul>", "<footer>&copy; somebody</footer>"
    bodies = [
        f"<article><p>{text}</p><p>{text}</p></article>",
        f"<article><header><h1>A title</h1></header><p>{text}</p><p>{text}</p></article>",
        f"<div id=x><div class=row><div class=col><p>{text}</p><ul><li>{text}</li></ul></div></div></div>",
        f"<table><tr><td><a href=/>Home</a><br><a href=/x>News</a></td><td><p>{text}</p><p>{text}</p></td></tr></table>",
        f"<article><p>{text} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><object><p>{text}</p></object></article>",
    ]
    for body in bodies:
        found = htmltree.extract(f"<html><body>{menu}{body}{foot}</body></html>", model)
        assert found.count(text) == 2 and "Home" not in found and "somebody" not in found
    assert found.endswith(text) and "x=2" in found


TITLE = "<h1>A long title of things</h1>"
LINES = ["This is the first paragraph of the article, and it says something about the weather.", "Second paragraph with more words about rivers and hills and towns.", "Third one ends it here, with a last remark."]
ARTICLE = TITLE + "".join(f"<p>{x}</p>" for x in LINES)
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
SIDE = "<div class='sidebar'><h3>About</h3><p>We write about many things. Read on and learn more of us.</p></div>"
FOOT = "<footer>&copy; example 2020</footer>"
COMMENTS = "<div class='comments'><h3>Comments</h3>" + "".join(f"<div class='comment'><p>I think that number {i} is quite right about this, thank you for it.</p></div>" for i in range(8)) + "</div>"
EVERYDAY = {
    "body has-sidebar": f"<body class='single has-sidebar'>{MENU}<div>{ARTICLE}</div>{SIDE}{COMMENTS}{FOOT}</body>",
    "body no-comments": f"<body class='no-comments'>{MENU}<article>{ARTICLE}</article>{FOOT}</body>",
    "main with-nav": f"<body>{MENU}<main class='page with-nav'>{ARTICLE}</main>{SIDE}{COMMENTS}{FOOT}</body>",
    "layout sidebar-left": f"<body>{MENU}<div class='layout sidebar-left'><div class='content'>{ARTICLE}</div>{SIDE}</div>{FOOT}</body>",
    "article ads-enabled": f"<body>{MENU}<article class='ads-enabled'>{ARTICLE}</article>{COMMENTS}{FOOT}</body>",
    "column more": f"<body>{MENU}<div class='main-column more'>{ARTICLE}</div>{SIDE}{FOOT}</body>",
    "form around the page": f"<body><form id='aspnetForm' method=post><input>{MENU}<div id='content'>{ARTICLE}</div>{SIDE}{FOOT}</form></body>",
    "wiki": f"<body><div id='page-base'></div><div id='content' class='wiki-body'>{ARTICLE}</div><div id='wiki-navigation'>{MENU}</div>{FOOT}</body>",
    "no name at all": f"<body>{ARTICLE}</body>",
    "site parts": f"<body class='page-template widget-area-on header-fixed'><div class='site-header'>{MENU}</div><div class='site-main'><div class='post'>{ARTICLE}</div>{COMMENTS}</div><div class='site-footer'><p>Imprint and other things are here.</p></div></body>",
}


@pytest.mark.parametrize("name", EVERYDAY)
def test_names_of_wrappers_and_holders_do_not_decide(name):
    found = htmltree.extract(f"<html>{EVERYDAY[name]}</html>", htmltree.default_model())
    assert found.split("\n\n") == ["A long title of things", *LINES]


@pytest.mark.parametrize("piece", ["<a '", '<a ="', "<div>", "<svg>", "</x>", "<x>", "<li>", "<p><b>", "<!--", "<a b='>' c=\"", "<td><li>"])
def test_hostile_pages_take_linear_time(piece):
    model = htmltree.default_model()
    times = []
    for size in (100_000, 1_000_000):
        began = time.process_time()
        htmltree.extract(piece * (size // len(piece)), model)
        times.append(time.process_time() - began)
    assert times[1] < 25 * max(times[0], 0.05)


def test_pages_awkward(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>"), (2, "u", "<html><body><nav><a>Home</a></nav><article><h1>Title</h1><p>Tom &amp; Ann\n went   out.</p></article><footer>&copy; x</footer></body></html>"), (3, "u", "<div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    found = {(r.page_id, r.text) for r in htmltree.main_text(pages).collect()}
    assert (2, "Title\n\nTom & Ann went out.") in found
    assert (1, "") in found
    assert htmltree.main_text(pages.limit(0)).count() == 0
