"""Toxicity, language identification, FLAC, sampled segmentations, HTML and WARC, with awkward inputs."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalis.llm import flac_media, html_extract, language_id, sp_sampling, toxicity, warc_index
from intervalis.llm.common import crc_remainder, table
from intervalis.llm.queries import QUERIES, piece_model

from .helpers import flac_samples

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def noisy(rng, insult, n):
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    if insult:
        for _ in range(max(1, n // 40)):
            words[rng.randrange(n)] = insult
    return " ".join(words)


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(1)
    texts = [noisy(rng, rng.choice(["zxwidiot", "quorpscum"]) if i % 4 == 0 else None, rng.randint(20, 300)) for i in range(600)]
    return toxicity.train(texts, [int(i % 4 == 0) for i in range(600)])


def test_toxicity_generalizes_to_misspellings(toxic_model):
    rng = random.Random(2)
    scores = lambda word, n: toxic_model.scores([noisy(rng, word, n) for _ in range(60)], {})
    assert (scores("zxwidiot", 100) >= 0.3).mean() > 0.95 and (scores(None, 100) < 0.3).mean() > 0.95
    seen, unseen, plain = toxic_model.word_logits(["zxwidiot", "zxwidi0tt", "abcdefg"])
    assert seen > unseen > 0.2 * seen > 10 * abs(plain)
    assert (scores("zxwidiot", 1500) >= 0.3).mean() > 0.9


def test_toxicity_of_awkward_rows(spark, toxic_model):
    rows = [(1, None, "x"), (2, "", "x"), (None, "zxwidiot " * 5, "x"), (3, "a", "x"), (3, "a", "x"), (4, "퟿ é \n", "x")]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string, score string"), toxic_model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert out[0].score == out[1].score and out[3] == out[4] and out[2].score > 0.5
    assert toxicity.score(spark.createDataFrame([], "doc_id bigint, text string"), toxic_model).collect() == []


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    one = toxicity.fit(docs, spark.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id bigint, toxic int"))
    assert len({r.score for r in toxicity.score(docs, one).collect()}) == 1


@needs_data
def test_toxicity_held_out(spark):
    """Precision and recall on labelled texts that were not learned from, also with every telling word misspelled."""
    large = DATA.replace("sf0.01", "sf0.1")
    docs, labels = table(spark, large, "documents"), table(spark, large, "labels")
    model = toxicity.fit(docs, labels)
    held = crc_remainder(F.col("doc_id"), 4) == 2
    rows = docs.join(labels.where("toxic IN (0, 1)"), "doc_id").where(held).select("text", "toxic").collect()
    toxic = np.array([r.toxic for r in rows])
    found = model.scores([r.text for r in rows], {}) >= toxicity.THRESHOLD
    assert (found & (toxic == 1)).sum() >= 0.85 * found.sum() and (found & (toxic == 1)).sum() >= 0.85 * toxic.sum()
    known = {w for r in docs.where(~held).select("text").collect() for w in (r.text or "").lower().split()}
    texts = []
    for r in rows:
        if r.toxic:
            words = (r.text or "").lower().split()
            wrong = [w[:-2] + w[-3] + w[-2:] if len(w) > 3 and logit > 20 else w for w, logit in zip(words, model.word_logits(words), strict=True)]
            if wrong != words and all(w in known or w not in words for w in wrong if w not in words):
                texts.append(" ".join(wrong))
    unseen = model.scores(texts, {}) >= toxicity.THRESHOLD
    assert len(texts) > 50 and unseen.mean() > 0.6


@needs_data
def test_toxicity_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, DATA).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    labels = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    flagged = [labels[i] for i, r in rows.items() if r.held_out and i in labels and r.predicted]
    assert sum(flagged) > 0.5 * len(flagged) and sum(flagged) >= 8


def test_toxicity_score_against_brute_force(toxic_model):
    """The score of a text, n-gram by n-gram and segment by segment."""

    def logit(word):
        marked, rows = f"<{word}>", []
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                h = 0
                for step, c in enumerate(marked[i : i + n], 1):
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + step) % 2**64
                rows.append(h)
        rows.append(toxicity.hash_word(word))
        buckets = [((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % 2**64 >> 46 for h in rows]
        return sum(float(toxic_model.weights[b]) for b in buckets) / len(buckets)

    rng = random.Random(4)
    for text in ("zxwidiot", "", noisy(rng, "quorpscum", 40), noisy(rng, None, 16), noisy(rng, "zxwidiot", 100)):
        logits = [np.float32(logit(w)) for w in text.split()]
        n = len(logits)
        starts = [0] if n <= 16 else [*range(0, n - 16, 8), n - 16]
        means = [float(np.mean(logits[a : a + 16], dtype=np.float64)) if n else 0.0 for a in starts]
        odds = sum(math.exp(m) for m in means) / (2 if len(means) > 1 else 1)
        z = toxic_model.scale[0] * (math.log(odds) + toxic_model.bias) + toxic_model.scale[1]
        assert abs(toxic_model.scores([text], {})[0] - 1 / (1 + math.exp(-z))) < 1e-4


def test_language_prediction_against_brute_force():
    """Windows, filters, pooling and softmax, written out for one text."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(600)) for _ in range(6)] + ["".join(rng.choice("xyz ") for _ in range(600)) for _ in range(6)]
    network = language_id.train(texts, ["A"] * 6 + ["X"] * 6, steps=60)
    text = "".join(rng.choice("abcxyz é") for _ in range(700))
    data, total = text.encode(), np.zeros(2)
    for at in range(0, len(data), language_id.WINDOW):
        part = data[at : at + language_id.WINDOW]
        row = list(part) + [0] * (language_id.WINDOW - len(part))
        pooled = []
        for width, kernel in zip(language_id.WIDTHS, network.filters, strict=True):
            responses = [np.concatenate([network.embed[b] for b in row[i : i + width]]) @ kernel for i in range(language_id.WINDOW - width + 1)]
            pooled.append(np.maximum(np.max(responses, axis=0), 0))
        z = np.concatenate(pooled) @ network.soft + network.bias
        total += len(part) * (z - np.log(np.exp(z).sum()))
    p = np.exp(total / len(data))
    p /= p.sum()
    (name,), (score,) = language_id.predict(network, [text])
    assert name == network.languages[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_learned_labels_avoid_the_held_out_fold(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.extend(texts))
    docs = spark.createDataFrame([(i, str(i)) for i in range(200)], "doc_id bigint, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int"))
    assert sorted(map(int, seen)) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    monkeypatch.setattr(language_id, "train", lambda texts, langs: seen.extend(texts))
    seen.clear()
    language_id.fit(docs.selectExpr("doc_id", "text", "if(doc_id % 3 = 0, 'a', 'b') AS lang"))
    assert sorted(map(int, seen)) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]


@needs_data
def test_language_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, DATA).collect()}
    truth = {r.doc_id: r.lang for r in table(spark, DATA, "documents").select("doc_id", "lang").collect()}
    held = [truth[i] == r.lang_pred for i, r in rows.items() if r.held_out]
    assert np.mean(held) > 0.97 and all(0 <= r.score <= 1 for r in rows.values())


def test_language_of_awkward_rows(spark):
    network = language_id.train(["the of and " * 40, "der die und " * 40] * 10, ["en", "de"] * 10, steps=60)
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the of and", "x"), (4, "the of and", "x"), (None, "der die und " * 3000, "x")]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string"), network).collect()
    assert [(r.lang_pred, r.score) for r in out[:3]] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in out[3:]] == ["en", "en", "de"] and out[3] == out[4]
    assert language_id.identify(spark.createDataFrame([], "doc_id bigint, text string"), network).collect() == []
    untrained = language_id.fit(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert language_id.predict(untrained, ["the of"]) == (["und"], [0.0])


# -- FLAC


def payloads():
    rng = np.random.default_rng(1)
    text = ("The quick brown fox jumps over the lazy dog, é. " * 40).encode()
    out = [b"\xff" * 576, b"\x00" * 1152, bytes(range(256)) * 9, rng.integers(0, 256, 576 * 70, dtype=np.uint8).tobytes(), text[: 576 * 3], bytes([0, 255] * 288)]
    return [*out, (128 + 100 * np.sin(np.arange(5760) / 9)).astype(np.uint8).tobytes()]


def test_flac_round_trip_and_seeking():
    files = flac_media.encode(payloads())
    assert flac_media.decode(files) == payloads()
    for p, f in zip(payloads(), files, strict=True):
        for first in (0, 100, len(p) - 600, len(p) - 1):
            assert flac_media.read_samples(f, max(0, first), 700) == p[max(0, first) : max(0, first) + 700]
    assert len(files[0]) < 120 and len(files[6]) < 0.8 * len(payloads()[6])


def test_flac_damage_is_found():
    whole = flac_media.encode(payloads()[3:5])[1]
    for at in (30, 66, 300, len(whole) - 1):  # the MD5, a header, a residual, a checksum
        damaged = bytearray(whole)
        damaged[at] ^= 8
        with pytest.raises(ValueError):
            flac_media.decode([bytes(damaged)])


def test_flac_decodes_what_its_encoder_never_writes():
    """A frame with partitions, five-bit parameters, an escape and a third-order fixed predictor, written bit by bit."""
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.integers(-2, 3, 576)).clip(-100, 100)
    residual = x[3:] - 3 * x[2:-1] + 3 * x[1:-2] - x[:-3]
    bits = "0" + f"{8 + 3:06b}" + "0" + "".join(f"{int(v) & 255:08b}" for v in x[:3]) + "01" + "0010"
    for part in range(4):
        own = residual[max(0, part * 144 - 3) : part * 144 + 141]
        if part == 2:
            bits += "11111" + "01100" + "".join(f"{int(v) & 4095:012b}" for v in own)
            continue
        bits += f"{part:05b}"
        for v in own.tolist():
            u = 2 * v if v >= 0 else -2 * v - 1
            bits += "0" * (u >> part) + "1" + (f"{u & ((1 << part) - 1):0{part}b}" if part else "")
    bits += "0" * (-len(bits) % 8)
    frame = flac_media._header(0) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = flac_media._crc16(np.frombuffer(frame, dtype=np.uint8), np.array([0]), np.array([len(frame)]))[0]
    frame += int(crc).to_bytes(2, "big")
    info = bytes(10) + ((8000 << 44) | (7 << 36) | 576).to_bytes(8, "big") + hashlib.md5(x.astype(np.int8).tobytes()).digest()
    media = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame
    assert flac_media.decode([media]) == [(x + 128).astype(np.uint8).tobytes()]


def test_flac_columns(spark):
    rows = [(1, None, "m"), (2, "", "m"), (3, "hé" * 2000, "m"), (3, "hé" * 2000, "m"), (None, "x", "m")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media string")
    stored = flac_media.with_media(df)
    out = flac_media.media_digests(stored).collect()
    for r, (_, text, _) in zip(out, rows, strict=True):
        raw = (text or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert out[0][1:] == out[1][1:] and out[2] == out[3]
    blocks = flac_media.pcm_blocks(stored.where("doc_id = 2")).collect()
    assert [(b.block, b.sample_offset, b.n_samples) for b in blocks] == [(0, 0, 576)] and set(blocks[0].pcm) == {0x7F}
    assert flac_media.with_media(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_flac_digests_against_a_plain_reader(spark):
    """Every contract column from the stored file, read bit by bit; blocks begin where the seek table says."""
    rng = random.Random(3)
    texts = ["", "short", "".join(rng.choice("abc déf,. ") for _ in range(70 * 576)), "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(900))]
    stored = flac_media.with_media(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    blocks = {}
    for b in flac_media.pcm_blocks(stored).collect():
        blocks.setdefault(b.doc_id, []).append((b.sample_offset, b.n_samples, bytes(b.pcm)))
    for r in flac_media.media_digests(stored).collect():
        frames = flac_samples(files[r.doc_id])
        x = [v for _, own in frames for v in own]
        payload = bytes(v + 128 for v in x)
        assert payload[: r.n_bytes] == texts[r.doc_id].encode() and set(payload[r.n_bytes :]) <= {255}
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert r.feature == f"mean={sum(x) * 100 // len(x)};power={sum(v * v for v in x) * 100 // len(x)};crossings={crossings};low={min(x)};high={max(x)}"
        points = flac_media.seek_points(files[r.doc_id])
        assert [(s // 576, o) for s, o in points] == [(i, frames[i][0]) for i in range(0, len(frames), flac_media.SEEK_EVERY)] and r.n_blocks == len(points)
        own = sorted(blocks[r.doc_id])
        assert [s for s, _, _ in own] == [s for s, _ in points] and b"".join(p for _, _, p in own) == bytes(v & 255 for v in x)


def test_flac_damaged_seek_table_is_found():
    media = bytearray(flac_media.encode(payloads()[3:4])[0])
    at = media.index(b"\x83") + 4 + 18  # the second point: its sample, then its offset
    for place in (at + 7, at + 15):
        damaged = bytearray(media)
        damaged[place] ^= 1
        with pytest.raises(ValueError):
            flac_media.read_blocks([bytes(damaged)])


# -- sampled segmentations


def test_samples_follow_the_lattice_distribution():
    np.seterr(over="ignore")
    vocab = sp_sampling.vocabulary(piece_model())
    units = sp_sampling.words("thing on")
    lattice = sp_sampling.Lattice(vocab, units, sp_sampling.ALPHA)

    def paths(place, end):
        if place == end:
            yield (), 0.0
            return
        for e in range(lattice.start[place], lattice.start[place + 1]):
            for rest, log in paths(lattice.tail[e], end):
                yield (int(lattice.piece[e]), *rest), log + lattice.log[e]

    every = {a + b: p + q for a, p in paths(lattice.base[0], lattice.end[0]) for b, q in paths(lattice.base[1], lattice.end[1])}
    assert abs(sum(map(math.exp, every.values())) - 1) < 1e-9
    seeds = np.arange(1, 6001).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = sp_sampling.sample_texts(vocab, ["thing on"] * 6000, seeds, 2)
    pairs = Counter((tuple(a[0].tolist()), tuple(b[0].tolist())) for a, b in out)
    for a, b in itertools.permutations(sorted(every, key=every.get)[-3:], 2):
        p = math.exp(every[a]) * math.exp(every[b]) / (1 - math.exp(every[a]))
        assert abs(pairs[(a, b)] / 6000 - p) < 5 * math.sqrt(p / 6000)
    for s in sorted(every, key=every.get)[-3:]:  # inverse inclusion scores are unbiased
        assert abs(np.mean([sum(1 / x[3] for x in own if tuple(x[0].tolist()) == s) for own in out]) - 1) < 0.1


def test_all_segmentations_of_a_short_text():
    vocab = sp_sampling.vocabulary(piece_model())
    np.seterr(over="ignore")
    for text in ("a", "on", "  ", "x\ty"):
        units = sp_sampling.words(text)
        lattice = sp_sampling.Lattice(vocab, units, sp_sampling.ALPHA)
        total = 1
        for u in range(len(units)):
            ways = {int(lattice.end[u]): 1}
            for place in range(int(lattice.end[u]) - 1, int(lattice.base[u]) - 1, -1):
                ways[place] = sum(ways[int(lattice.tail[e])] for e in range(lattice.start[place], lattice.start[place + 1]))
            total *= ways[int(lattice.base[u])]
        (found,) = sp_sampling.sample_texts(vocab, [text], np.array([5], dtype=np.uint64), 10_000)
        assert len({tuple(f[0].tolist()) for f in found}) == len(found) == total and all(f[3] == 1.0 for f in found)
        assert all(a[2] >= b[2] for a, b in itertools.pairwise(found))


def test_sampling_rows(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = [(1, None), (2, ""), (3, " lead  é 中☃\x00\n\U0001f600 "), (4, "same words"), (4, "same words"), (None, "w " * 3000)]
    df = spark.createDataFrame(rows, "k bigint, text string").selectExpr("*", "'clash' AS rank")
    run = lambda n: sp_sampling.sample(df.repartition(n), piece_model(), ["k"], keep_ids=True).collect()
    out = run(1)
    assert sorted(map(str, out)) == sorted(map(str, run(5))) and all(r.round_trip for r in out)
    assert [(r.n_pieces, r.inclusion) for r in out if r.k in (1, 2)] == [(0, 1.0)] * 2
    for k, text in rows:
        for r in out:
            if r.k == k and text:
                assert model.decode(r.ids) == text and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    assert sp_sampling.sample(spark.createDataFrame([], "k bigint, text string"), piece_model(), ["k"]).collect() == []


@needs_data
def test_sampling_covers_all_documents(spark):
    small = DATA.replace("sf0.01", "sf0.001")
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    out = QUERIES["op9_sentencepiece_sampling"](spark, small).collect()
    assert {r.doc_id for r in out} == set(texts) and all(r.round_trip for r in out)
    ranks = Counter(r.doc_id for r in out)
    assert all(ranks[i] == 3 for i, t in texts.items() if t and len(t) > 20)


# -- HTML

PAGE = """<html><head><title>T, t.</title><style>p{}</style></head><body><header><h1>Site</h1><p>Tag line, here.</p></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, ok? Yes. No.</p></div>
%s<div class="sidebar"><p>Side text, yes. More of it, too.</p></div><div id="comments"><p>Nice post, thanks. I liked it, really.</p></div>
<form><p>Name, please.</p><textarea>x</textarea></form><div class=ad>Buy, now!</div><footer>&copy; 2020</footer><script>var a="</p>";</script></body></html>"""
BODY = "<h1>Title of it</h1><p>First para, with <b>bold</b>&nbsp;text &amp; more.<br>It goes on, really.<p>Second   para; &eacute;&#33;\n again.</p><p>Ok.</p>"
TEXT = "Title of it\nFirst para, with bold text & more. It goes on, really.\nSecond para; é! again.\nOk."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div id='content'>%s</div>", "<main><div>%s</div></main>", "<div><section class='post'>%s</section></div>"])
def test_main_text(wrap):
    assert html_extract.extract(PAGE % (wrap % BODY)) == TEXT


def test_path_scores_decide_inside_and_outside_article():
    para = "<p>" + "A long sentence, with some marks; it goes on, and on. " * 4 + "</p>"
    story, line = f"<div class=story><h1>Head</h1>{para * 5}<p>Ok.</p></div>", para[3:-4].strip()
    rail = "<div class=rail><h3>More</h3><ul>" + "<li><a href=x>Some link title</a></li>" * 8 + "</ul></div>"
    deal = "<div class=deal><div>Buy it</div><div>Cheap</div><div>Only today</div></div>"
    cards = "<article class=card><h2><a href=x>Teaser title</a></h2><div>Read it</div></article>" * 12
    expected = "\n".join(["Head", *[line] * 5, "Ok."])
    for page in (f"<main>{story}{rail}{deal}</main>", f"<article>{story}{rail}{deal}</article>", story + cards):
        assert html_extract.extract(f"<body>{page}</body>") == expected
    assert html_extract.extract(f"<article><h1>Head</h1><div>{para * 5}<ul><li>Item</li></ul></div></article>").split("\n")[::6] == ["Head", "Item"]


def test_damaged_pages():
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>never closed") == ""
    assert html_extract.extract("plain text only") == "plain text only"
    assert html_extract.extract("<p>unclosed <b>bold <p>next") == "unclosed bold\nnext"
    assert html_extract.extract("a < b and c > d <p>x & y &lt;z&gt;</p>") == "a < b and c > d\nx & y <z>"
    rng = random.Random(1)
    for _ in range(300):
        html_extract.extract("".join(rng.choice(["<p", ">", "<div class='ad\">", "</p>", "<!--", "-->", "text, ", "<a href=\"", "'", "&#xD800;", "&amp", "<script>", "</", "<br/>", "\n"]) for _ in range(30)))


def test_path_scores_cannot_be_replaced(monkeypatch):
    """With constant or random scores other text comes out: the ratios decide, not the names of elements."""
    para = "<p>" + "A long sentence, with some marks; it goes on, and on. " * 4 + "</p>"
    page = "<body>%s</body>" % ("<div class=story>" + para * 5 + "</div><div class=zz9><div>Buy it</div><div>Cheap</div></div><div class=qq7><span>Word</span></div>")
    for wrap in ("%s", "<main>%s</main>", "<article>%s</article>"):
        right = html_extract.extract(wrap % page)
        assert right == "\n".join([para[3:-4].strip()] * 5)
        for scores in (lambda f: np.ones(len(f)), lambda f: np.zeros(len(f)), lambda f: np.random.default_rng(1).random(len(f))):
            with monkeypatch.context() as m:
                m.setattr(html_extract, "path_scores", scores)
                assert html_extract.extract(wrap % page) != right


def test_path_ratios_against_brute_force():
    """Sums by path, smoothing and product, written out block by block."""
    rng = random.Random(8)
    for _ in range(40):
        parts = [rng.choice(["<div>%s</div>", "<p>%s</p>", "<ul><li>%s</li></ul>", "<section><p>%s</p></section>", "<div class=x><a href=y>%s</a></div>", "<nav>%s</nav>"]) for _ in range(rng.randint(1, 30))]
        page = "".join(p % " ".join(rng.choice(["word", "more, text.", "and; so!"]) for _ in range(rng.randint(1, 30))) for p in parts)
        found = html_extract.blocks(page)

        def path(block):
            node, steps = block.element, []
            while node is not None:
                steps.append(node.label)
                node = node.parent
            return "/".join(reversed(steps))

        def ratio(count):
            def of(block):
                same = [b for b in found if path(b) == path(block)]
                return np.log1p(sum(0 if b.element.bad else count(b) for b in same) / len(same))

            raw = [of(b) for b in found]
            weights = [np.exp(-0.5 * k * k) for k in (-2, -1, 0, 1, 2)]
            return [sum(w * raw[min(max(i + k, 0), len(raw) - 1)] for k, w in zip((-2, -1, 0, 1, 2), weights, strict=True)) / sum(weights) for i in range(len(raw))]

        text = ratio(lambda b: max(0, len(b.text) - b.linked))
        marks = ratio(lambda b: sum(c in ".,;:!?…。、，；：！？¿¡\"'()«»„“”–—-" for c in b.text))
        assert np.allclose(html_extract.path_scores(found), np.array(text) * np.array(marks))


def test_huge_damaged_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for unit in ("<a ", "<div>", "<div><p>x", "</x>", "<ul><li>y", "<script '", "<!-", "<p class='a>"):
        html_extract.extract(unit * (1_000_000 // len(unit)))
    html_extract.extract("<ul>" * 100_000 + "<b>x</b><li>y" * 50_000 + "</q>" * 100_000)
    assert time.perf_counter() - began < 60


def test_html_rows(spark):
    rows = [(1, "u", None, "x"), (2, "u", "&#xD800;<p>é</p>", "x"), (2, "u", "<p>é</p>", "x"), (3, None, "<p>" + "w, " * 50_000 + "</p>", "x")]
    out = html_extract.with_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [r.n_chars for r in out] == [len(r.text) for r in out] and out[0].text == "" and len(out[3].text) == 3 * 50_000 - 1
    assert html_extract.with_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


# -- WARC


def test_surt():
    assert warc_index.surt("http://www.Example.com:80/a?c=2&b=1#x") == "com,example,www)/a?b=1&c=2"
    assert warc_index.surt(None) == "-" and warc_index.surt("http://h:8080") == "h:8080)/"
    assert " " not in warc_index.surt("http://[bad url") + warc_index.surt("h ttp://a b/c d")


def test_archives(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a.com/x", big), (5, "http://b.com/", big), (5, "http://b.com/", big), (3, "http://a.com/x", "small"), (4, None, None), (None, "http://c.com/\r\n", big), (9, "http://z.com/", "small")]
    rows += [(100 + i, f"http://site.com/{i}", f"page {i}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest")
    captures, directory, folder = warc_index.archive(pages, str(tmp_path / "warc"), 3)
    out = warc_index.look_up(pages, directory, folder).collect()
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = i == 1
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))
    small = warc_index.build_index(captures, str(tmp_path / "warc"), 2, block_lines=4)
    assert sorted(map(str, map(tuple, warc_index.look_up(pages, small, folder).collect()))) == sorted(map(str, expected))
    index = warc_index.Index(warc_index.index_parts(small), folder)
    assert small.count() > 12 and len(index.parts) == 2
    for i, url, html in rows[7:] + rows[:1]:
        lines = [x for x in index.captures(url) if x[1] == str(i)]
        assert len(lines) == 1 and index.fetch(lines[0])[2] == (b"" if i == 1 else html.encode())
    assert sorted(x[1] for x in index.captures("http://a.com/x")) == ["1", "3"] and index.captures("http://none.com/") == []
    _, empty, folder = warc_index.archive(pages.limit(0), str(tmp_path / "none"), 2)
    assert warc_index.look_up(pages.limit(0), empty, folder).collect() == [] and warc_index.look_up(pages, empty, folder).collect() == []
    many = spark.createDataFrame([(i if i % 3 else None, None if i % 2 else "http://hot/", f"p{i // 2}") for i in range(300)], "page_id bigint, url string, html string")
    _, directory, folder = warc_index.archive(many, str(tmp_path / "hot"), 4)
    out = warc_index.look_up(many, directory, folder).collect()
    assert Counter((r.page_id, r.payload_digest) for r in out) == Counter((r.page_id, hashlib.sha1(r.html.encode()).hexdigest()) for r in many.collect())


def test_a_repeated_write_gives_the_same_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i % 3}", "x" * i) for i in range(40)], "page_id bigint, url string, html string")
    one, _, first = warc_index.archive(pages, str(tmp_path / "a"), 2)
    two, _, second = warc_index.archive(pages.repartition(5), str(tmp_path / "b"), 2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    for name in ("archive-000000.warc.gz", "archive-000001.warc.gz"):
        with open(f"{first}/{name}", "rb") as a, open(f"{second}/{name}", "rb") as b:
            assert a.read() == b.read()
