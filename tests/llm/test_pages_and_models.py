"""Pages, archives, secrets, the classifier, decontamination and the pipeline."""

from __future__ import annotations

import base64
import collections
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsmith.llm import decontaminate, html_layout, ordinal, secret_scan, warc
from tabsmith.llm.common import scratch_path
from tabsmith.llm.words import words

from .conftest import DOCUMENTS, nasty_texts, prose, table

PAGES = "page_id long, url string, html string, key string, digest string, file string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", "f", "t") for r in rows], PAGES)


@pytest.mark.parametrize(("html", "text"), [
    ("", ""),
    ("no tags &amp; none", "no tags & none"),
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<head><title>t</title></head><body>a<div>b</div>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x</table>", "Name      | N\nlong name | 1\nx"),
    ("<p hidden>a</p><p style='display: none'>b</p><p style='visibility:hidden'>c<b style='visibility:visible'>d</b></p>e", "d\n\ne"),
    ("<style>.x, #y {display:none}</style><i class='z x'>a</i><i id=y>b</i><i class=z>c</i>", "c"),
    ("<pre>\n a  b\nc</pre>d", " a  b\nc\n\nd"),
    ("<script>if (a < b) '<p>no</p>'</script>x<!-- <p>no --> y", "x y"),
    ("a<b>b</b> <i> c</i>d", "ab cd"),
    ("<p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"),
    ("<td>stray</td><p title='a>b'>x</p>", "stray\n\nx"),
    ("<p>5 < 6 & 7 > 3", "5 < 6 & 7 > 3"),
    ("x</p>y</div>z", "x\n\nyz"),
    ("<dl><dt>t<dd>d</dl><hr><h1>h</h1>", "t\n  d\n\nh"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in | ner | out"),
    ("<template>t</template><dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<p", ""), ("<", "<"), ("a<!-- never closed", "a"), ("<p>&#160;x&nbsp;y", " x y"),
])
def test_layout(html, text):
    assert html_layout.render(html) == text


def test_deep_and_long_pages():
    assert html_layout.render("<div>" * 20_000 + "deep") == "deep"
    assert html_layout.render("<p>" + "word " * 400_000).count("word") == 400_000
    assert html_layout.render("<b " * 50_000) is not None


def test_extract(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "<p>x"), (3, "u", "<p>x")]
    got = html_layout.extract(pages(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(1, ""), (2, ""), (None, "x"), (3, "x"), (3, "x")])
    assert html_layout.extract(pages(spark, [])).count() == 0


def test_layout_keeps_all_words(spark):
    from html.parser import HTMLParser
    from pathlib import Path

    path = Path("/root/testdata/sf0.001/pages.parquet")
    if not path.exists():
        pytest.skip("no test data")

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("head", "script", "style")
            self.out.append(" " if tag not in ("b", "i", "a") else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("head", "script", "style")
            self.out.append(" " if tag not in ("b", "i", "a") else "")

        def handle_data(self, data):
            self.out.append("" if self.hidden else data)

    df = spark.read.parquet(str(path))
    texts = {r["page_id"]: r["text"] for r in html_layout.extract(df).collect()}
    for r in df.collect():
        parser = Words()
        parser.feed(r["html"])
        parser.close()
        plain = [w for w in "".join(parser.out).split() if w != "-"]
        assert [w for w in texts[r["page_id"]].split() if w != "-"] == plain


def test_archives_round_trip(spark):
    long, other = "<p>" + prose(1, 400), "<p>" + prose(2, 400) + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(k, f"http://www.h{k % 5}.example.com/p/{k}?q=1", f"<p>{prose(k, 30)}") for k in range(200)]
    rows += [(300 + k, f"https://Copy.example.org:8080/{k}", long) for k in range(40)] + [(400, "http://x.example/\r\nA: b c", other), (401, None, other)]
    rows += [(500, "u", None), (501, "", ""), (502, "u", "same"), (503, "u", "same"), (None, "http://n.example/", long), (504, "é.example/ü", "é" * 3000)]
    rows += [(504, "é.example/ü", "é" * 3000), (None, None, None)]
    root = scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark, rows).repartition(4), f"{root}/archives")
    index = warc.CaptureIndex.build(spark, f"{root}/archives", f"{root}/index", block_rows=16)
    got = warc.read_captures(index.captures()).collect()
    largest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    expected = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h in largest and largest[h] != i
        expected[i, "revisit" if revisit else "response", hashlib.sha1(data).hexdigest(), len(data), largest[h] if revisit else None, None if revisit else data] += 1
    assert collections.Counter((r["page_id"], r["record_type"], r["payload_digest"], r["payload_bytes"], r["refers_to"],
                                None if r["payload"] is None else bytes(r["payload"])) for r in got) == expected
    firsts = [r["first_key"] for r in index.directory().orderBy("block").collect()]
    assert len(firsts) > 5 and firsts == sorted(firsts)
    everything = collections.Counter(map(tuple, index.captures().collect()))
    assert collections.Counter(map(tuple, index.find_urls(pages(spark, rows)).collect())) == everything
    hot = index.lookup("https://copy.example.org:8080/7").collect()
    assert [h["page_id"] for h in hot] == [307] and {r["page_id"] for r in index.lookup("u").collect()} == {500, 502, 503}
    for i, url, h in rows[:200:67]:
        (hit,) = index.lookup(url).collect()
        fields, body = warc.read_record(hit["file"], hit["offset"], hit["length"])
        assert hit["page_id"] == i and body.endswith(h.encode()) and fields["WARC-Target-URI"] == url
    assert index.lookup("http://nowhere.example/").count() == 0
    keys = [r["key"] for r in index.captures().collect()]
    assert len(keys) == len(rows) and warc.url_key("http://www.a.example.com/P?Q") == "com,example,a)/p?q"


def test_a_hot_key_spans_blocks_and_directory_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "DIRECTORY_ROWS", 2)
    rows = [(k, "http://hot.example/" if k % 3 == 0 else f"http://h.example/{k % 40}", f"<p>{k}") for k in range(300)]
    root = scratch_path(spark, "warc-hot")
    warc.write_archives(pages(spark, rows).repartition(3), f"{root}/archives")
    index = warc.CaptureIndex.build(spark, f"{root}/archives", f"{root}/index", block_rows=8)
    assert len(index._files()) > 4
    assert sorted(r["page_id"] for r in index.lookup("http://HOT.example").collect()) == list(range(0, 300, 3))
    assert sorted(r["page_id"] for r in index.find_urls(pages(spark, rows)).collect()) == list(range(300))


def test_empty_archive(spark):
    _, index = warc.archived(pages(spark, []))
    assert index.captures().count() == 0 and index.lookup("http://a.example/").count() == 0 and warc.read_captures(index.captures()).count() == 0


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else (lambda n: bytes([0x80 | len(n)]) + n)(size.to_bytes((size.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + head + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, number(0), *[number((1 << 511) + k) for k in range(8)])
PKCS8 = der(0x30, number(0), der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), b"\x05\x00"), der(4, RSA))
EC = der(0x30, number(1), der(4, b"\x11" * 32), der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
SSH = b"openssh-key-v1\0" + b"".join(len(f).to_bytes(4, "big") + f for f in (b"none", b"none", b"")) + b"\0\0\0\1" + b"".join(
    len(f).to_bytes(4, "big") + f for f in (b"p" * 51, b"q" * 120))


def b64(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()


def jwt(header, claims, signature=b"sig" * 10):
    return ".".join(b64(x, True).rstrip("=") for x in (json.dumps(header).encode(), json.dumps(claims).encode(), signature))


def test_structural_secrets():
    kinds = lambda text: [k for k, *_ in secret_scan.spans(text)]
    for key in (RSA, PKCS8, EC):
        assert kinds("x " + b64(key) + " y") == ["der"]
        assert "der" in kinds("x " + key.hex() + " y")
        assert kinds(b64(key[:-3])) == [], "lengths must add up"
    assert kinds("x " + b64(SSH)) == ["ssh"] and kinds(b64(SSH[:-1])) == []
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(RSA))) + "\n-----END RSA PRIVATE KEY-----"
    assert "pem" in kinds("a " + pem + " b")
    assert kinds("-----BEGIN PRIVATE KEY-----\nbm90IGEga2V5\n-----END PRIVATE KEY-----") == []
    assert kinds(jwt({"alg": "HS256"}, {"sub": 1})) == ["jwt"]
    assert kinds(jwt({"typ": "x"}, {"sub": 1})) == [] and kinds(jwt({"alg": "HS256"}, {"sub": 1}, b"")) == []
    assert kinds("M" + "A" * 200) == []
    (span,) = secret_scan.spans("é日 " + jwt({"alg": "none"}, {}))
    assert span[1] == 3


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_secrets_against_brute_force(spark, nasty, nothing):
    hexes = hashlib.sha256(b"x").hexdigest()
    texts = nasty_texts() + [
        (801, f"Token = '{hexes}' and PASSWORD:abc12 pass"), (802, "AKIA" + "A" * 16 + " AKIAAKIA" + "1" * 12 + " AKIA123"),
        (803, "é" * 10 + f' api_key":  "{hexes[:23]}" apikey=Key secret==abcdef=='), (804, hexes * 3 + "g" + hexes[:24]),
        (805, "token=" + jwt({"alg": "HS256"}, {"a": 1})), (805, "pass" + "word=" * 3 + "x" * 9), (None, "passwd = " + "y" * 7)]
    got = secret_scan.summary(secret_scan.find_secrets(table(spark, texts).repartition(3))).collect()
    expected = collections.Counter()
    for i, t in texts:
        base = brute_base(t or "")
        expected[i, base.count("assign:"), base.count("access:"), base.count("hex:"), hashlib.sha256(base.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == expected
    assert any("jwt:" in r["spans"] for r in got if r["doc_id"] == 805)
    assert secret_scan.find_secrets(nothing).count() == 0


def rated_table(spark, count=1500):
    texts, ratings = [], []
    for k in range(count):
        text, grade = prose(k, 60 + k % 90), 2
        if k % 7 == 0:
            text, grade = text.replace(" ", "!! ").upper(), 1
        elif k % 5 == 0:
            words = text.split()
            words[k % 50] = ["vilx", "vily"][k % 2] + prose(k, 1)
            text, grade = " ".join(words), 0
        texts.append((k, text))
        ratings.append((k, grade))
    return table(spark, texts), spark.createDataFrame(ratings, "doc_id long, grade int"), dict(ratings)


def test_ordinal_classifier(spark, nasty, nothing):
    docs, ratings, truth = rated_table(spark)
    model = ordinal.fit(docs, ratings.where("doc_id < 1000"))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = docs.select("doc_id", model.score().alias("s")).where("doc_id >= 1000").select("doc_id", "s.*").collect()
    good = [r["tail"] >= 0.5 for r in rows if truth[r["doc_id"]] == 2]
    bad = [r["tail"] < 0.5 for r in rows if truth[r["doc_id"]] < 2]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.95
    means = [np.mean([r["expected"] for r in rows if truth[r["doc_id"]] == g]) for g in range(3)]
    assert means == sorted(means)
    kept = ordinal.select_good(nasty, model)
    assert kept.columns == nasty.columns and kept.count() <= nasty.count()
    assert ordinal.select_good(nothing, model).count() == 0
    labels = spark.createDataFrame([(1, None, 0), (1, 1, None), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    graded = labels.select("doc_id", ordinal.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    none = ordinal.fit(nasty, graded)
    assert not len(none.thresholds) and ordinal.select_good(nasty, none).count() == nasty.count(), "no model rejects nothing"
    assert ordinal.fit(nothing, graded).thresholds.size == 0


def test_gradient(spark):
    rows = spark.createDataFrame([(0, [0, 2]), (1, [1]), (2, []), (1, [0, 1, 2]), (2, [2])], "grade int, at array<int>")
    rows = rows.repartition(2)
    weights, cuts = np.array([0.3, -0.2, 0.5]), np.array([-0.4, 0.7])
    loss, by_weight, by_cut = ordinal._loss(rows, weights, cuts)
    for i in range(3):
        near = weights.copy()
        near[i] += 1e-5
        assert abs((ordinal._loss(rows, near, cuts)[0] - loss) / 1e-5 - by_weight[i]) < 1e-3
    for i in range(2):
        near = cuts.copy()
        near[i] += 1e-5
        assert abs((ordinal._loss(rows, weights, near)[0] - loss) / 1e-5 - by_cut[i]) < 1e-3


def test_common_words():
    draw = np.random.default_rng(5)
    block = [decontaminate.Segment(k, draw.integers(0, 30, n).astype(np.uint64), 0) for k, n in enumerate((5, 20, 64, 63))]
    vocabulary = np.unique(np.concatenate([s.words for s in block]))
    confirm = decontaminate.Confirm(block, vocabulary)
    text = draw.integers(0, len(vocabulary) + 1, (40, 50))
    segment = np.arange(40) % 4

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    got = decontaminate.common_words(text, confirm.masks, segment, confirm.length[segment])
    assert got.tolist() == [lcs(t.tolist(), np.searchsorted(vocabulary, block[s].words).tolist()) for t, s in zip(text, segment)]


def test_leaks(spark, nothing):
    draw = np.random.default_rng(2)
    items = [(k, prose(9000 + k, 15 + k % 45, "klmnopqrst")) for k in range(300)]
    items += [(None, prose(9999, 30, "klmnopqrst")), (900, None), (901, ""), (902, "two words"), (903, prose(9998, 200, "klmnopqrst"))]
    texts, truth = [(k, prose(k, 20 + k * 3)) for k in range(150)], set()
    for k in range(60):
        item = items[draw.integers(0, 300)]
        words = item[1].split()
        if k % 3 == 0 and len(words) > 25:  # a paraphrase: every seventh word is another
            words = [w if j % 7 or j > len(words) - 8 else "other" for j, w in enumerate(words)]
        texts.append((1000 + k, prose(k, 50) + "\n" + " ".join(words).upper().replace(" ", ", ") + " " + prose(k + 1, 60)))
        truth.add((1000 + k, item[0]))
    texts += [(2000, items[-1][1]), (2000, items[-1][1]), (2001, prose(1, 70_000) + " " + items[0][1] + " " + prose(2, 100)), (None, items[5][1]), (2002, None)]
    truth |= {(2000, 903), (2001, 0), (None, 5)}
    docs = table(spark, texts).repartition(4)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string").repartition(2)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == truth
    clean = decontaminate.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == set(range(150)) | {2002}
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    docs, ratings, truth = rated_table(spark, 600)
    item = prose(4242, 40, "klmnopqrst")
    copy = prose(77, 80)
    more = table(spark, [(5000, copy), (5001, copy.replace(" ", "  ")), (5002, copy + " tail"), (5003, prose(3, 30) + " " + item + " " + prose(4, 30)),
                         (5004, None), (5005, ""), (None, prose(5, 50)), (5006, prose(6, 5000))])
    docs.unionByName(more).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    ratings.selectExpr("doc_id", "cast(grade > 0 and grade <> 1 or grade = 0 as int) as quality", "cast(grade = 0 as int) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in rows}
    good = {k for k, g in truth.items() if g == 2}
    assert len(good - ids) <= 0.03 * len(good) and len({k for k, g in truth.items() if g < 2} & ids) <= 0.1 * (600 - len(good))
    assert {5000, 5001, 5002} & ids == {5000} and 5003 not in ids and 5006 in ids and None in ids
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert DOCUMENTS


def test_leaks_in_a_hot_group(spark):
    item = prose(7000, 40, "klmnopqrst")
    words = item.split()
    benchmark = spark.createDataFrame([(1, item), (2, prose(7001, 40, "klmnopqrst"))], "item_id long, text string")
    texts = [(k, prose(k, 60)) for k in range(60)]
    for k in range(30):  # near copies of one text: each word of the paraphrase is in a third of all rows, the replaced ones are in none
        passage = " ".join("other" if j % 7 == 3 else w for j, w in enumerate(words))
        texts.append((1000 + k, prose(5, 50) + " " + passage + " " + prose(6, 50) + f" copy{k}"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table(spark, texts), benchmark).collect()}
    assert found == {(1000 + k, 1) for k in range(30)}


def test_leaks_against_brute_force(spark):
    draw = np.random.default_rng(11)
    known = prose(1, 400).split()
    chance = 1 / np.arange(1, len(known) + 1)
    say = lambda n: [known[i] for i in draw.choice(len(known), n, p=chance / chance.sum())]
    items = [say(n) for n in range(5, 65) for _ in range(2)]
    texts = []
    for k in range(480):
        held = list(items[k % len(items)])
        if k >= 240:  # a paraphrase
            held = [w if draw.random() < 0.8 else say(1)[0] for w in held]
        texts.append(" ".join(say(int(draw.integers(0, 150))) + held + say(int(draw.integers(0, 150)))))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    block = decontaminate.segments(pa.array([" ".join(w) for w in items]))
    vocabulary = np.unique(np.concatenate([s.words for s in block]))
    confirm = decontaminate.Confirm(block, vocabulary)
    expected = set()
    for k, w in enumerate(texts):
        (at,) = words(pa.array([w]), breaks=decontaminate.BREAKS)
        place = np.searchsorted(vocabulary, at.hash)
        terms = np.where(vocabulary[np.minimum(place, len(vocabulary) - 1)] == at.hash, place, len(vocabulary))
        window, segment = (x.ravel() for x in np.meshgrid(np.arange(len(terms) // 32 + 2), np.arange(len(block)), indexing="ij"))
        kept, share, answer = confirm.best(confirm.around(terms, window), segment)
        leak = (share >= decontaminate.SURE) | (share >= decontaminate.LIKELY) & (answer >= decontaminate.ANSWER)
        expected |= {(k, block[s].item) for s in segment[kept[leak]].tolist()}
    assert {(k, k % len(items)) for k in range(240)} <= expected
    got = decontaminate.leaks(table(spark, list(enumerate(texts))).repartition(4), benchmark)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    by_length = {n: sum(len(items[i]) == n for _, i in expected - found) for n in range(5, 65)}
    assert found == expected, by_length


def test_latent_space_is_of_all_documents(spark, monkeypatch):
    """With a basis as wide as the vocabulary the space is exact: the passages' A'A, items included, is diagonal in it."""
    monkeypatch.setattr(decontaminate, "SAMPLE_WORDS", 2_000, raising=False)  # once a bound on the words it was fitted on
    monkeypatch.setattr(decontaminate, "TERMS", 16, raising=False)
    known = [w for w in dict.fromkeys(prose(8, 100, "klmnopqrst").split())][:50]
    texts = [(k, " ".join(w if j % 9 else known[(7 * k + j * j) % 50] for j, w in enumerate(prose(k, 40 + 5 * k).split()))) for k in range(120)]
    texts += [(500, texts[119][1] * 40), (501, None), (502, "")]
    items = [" ".join(known[i : i + 10]) for i in range(0, 50, 10)]
    spaces, weighed = [], []
    whole, run = decontaminate.latent_space, decontaminate._normal_product
    monkeypatch.setattr(decontaminate, "_normal_product", lambda rows, weights, *rest: weighed.append((weights, *rest)) or run(rows, weights, *rest))
    monkeypatch.setattr(decontaminate, "latent_space", lambda *given: spaces.append(whole(*given)) or spaces[-1])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    decontaminate.leaks(table(spark, texts).repartition(3), benchmark).count()
    ((weights, rows, _), *_), (space,) = weighed, spaces
    vocabulary = np.unique(np.concatenate([s.words for s in decontaminate.segments(pa.array(items))]))
    rows = decontaminate.ITEM_WEIGHT * rows / np.linalg.norm(rows, axis=1, keepdims=True)
    square = rows.T @ rows
    for _, text in texts[:121]:
        (at,) = words(pa.array([text]), breaks=decontaminate.BREAKS)
        for i in range(0, len(at.hash), 2 * decontaminate.PASSAGE):
            value = weights * np.array([np.count_nonzero(at.hash[i : i + 2 * decontaminate.PASSAGE] == v) for v in vocabulary])
            square += np.outer(value, value) / max(value @ value, 1e-9)
    turned = space.T @ square @ space
    assert space.shape == (50, 50) and np.allclose(space.T @ space, np.eye(50), atol=1e-9)
    assert np.allclose(turned, np.diag(np.diag(turned)), atol=1e-6 * turned.max())
    assert np.allclose(np.diag(turned), np.linalg.eigvalsh(square)[::-1], rtol=1e-6)


def test_best_stretch_with_the_answer():
    """An earlier stretch has as many common words, but not the answer."""
    segment = decontaminate.Segment(0, np.arange(20, dtype=np.uint64), 15)
    confirm = decontaminate.Confirm([segment], segment.words)
    text = np.full((1, decontaminate.WINDOW), 20)
    text[0, :12] = np.arange(12)
    text[0, 60:72] = [0, 1, 2, 3, 4, 5, 6, 15, 16, 17, 18, 19]
    kept, share, answer = confirm.best(text, np.array([0]))
    assert kept.tolist() == [0] and share.tolist() == [0.6] and answer.tolist() == [1.0]


@pytest.mark.parametrize(("html", "text"), [
    ("<style>@media print { .nav, #side { display: none } }</style><i class=nav>a</i><i id=side>b</i>", "ab"),
    ("<style>@media (max-width: 600px) {p{display:none}} @media screen and (min-width: 40em) {b{display:none}}</style><p>a<b>c</b></p>", "a"),
    ("<style>@media not print{i{display:none}} @media only screen and (width < 50em), print {b{display:none}}</style><i>a</i><b>b</b>", "b"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>@import 'x.css'; @font-face{src:url('a;{b')} .x{display:none} .x{display:block}</style><p class=x>a", "a"),
    ("<style>.x{display:none !important} #y{display:block}</style><p class=x id=y style='display:block'>a</p>b", "b"),
    ("<style>#y{display:block} .x{display:none}</style><p class=x id=y>a", "a"),
    ("<style>/* p{display:none} */ i{display:none}</style><p>a<i>b</i>", "a"),
    ("<style>.x{visibility:hidden} .y{visibility:visible}</style><p class=x>a<b class=y>b</b></p>", "b"),
    ("<style>@supports (display:grid) { @media screen { .x { color:red; display:none } } } .z{}</style><i class=x>a</i>b", "b"),
    ("a<xmp><b>x</b> &amp;\n  y</xmp>b", "a\n\n<b>x</b> &amp;\n  y\n\nb"),
])
def test_visible_on_a_screen(html, text):
    assert html_layout.render(html) == text


def test_leaked_forms_of_keys():
    kinds = lambda text: [k for k, *_ in secret_scan.spans(text) if k not in secret_scan.BASE]
    for name, key, kind in (("RSA ", RSA, "der"), ("", PKCS8, "der"), ("OPENSSH ", SSH, "ssh")):
        lines = re.findall(".{1,64}", b64(key))
        pem = [f"-----BEGIN {name}PRIVATE KEY-----", *lines, f"-----END {name}PRIVATE KEY-----", ""]
        for glue in ("\\n", "\\r\\n", "\\\\n", "\r\n", "\\\n"):
            assert "pem" in kinds('{"key": "' + glue.join(pem) + '"}'), glue
        for glue in ("\n", "\r\n", "\\n", "\n    "):
            text = "x: " + glue.join(re.findall(".{1,44}", b64(key))) + glue + "and more text"
            (span,) = [s for s in secret_scan.spans(text) if s[0] == kind]
            assert span[1] == 3 and text[span[2] :] == glue + "and more text"
        assert kinds("\n".join(re.findall(".{1,44}", b64(key[:-3])))) == []
    head = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,0123456789ABCDEF\n\n"
    secret = hashlib.sha512(b"x").digest() * 4
    for escape in (lambda t: t, lambda t: t.replace("\n", "\\n")):
        assert kinds(escape(head + b64(secret) + "\n-----END RSA PRIVATE KEY-----")) == ["pem"]
        assert kinds(escape(head + b64(secret[:-3]) + "\n-----END RSA PRIVATE KEY-----")) == []
