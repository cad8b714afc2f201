"""Training-data operators against brute force, and on null, empty, long, repeated and clashing rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.llm import bpe, chat_format, compression, fingerprints, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules, token_output
from kinlink.llm.common import shingles

DATA = "/root/testdata/sf0.001"
LONG = "word other thing. " * 30_000
#: Names that clash with columns that operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, nid long, block long, n_words long, bucket long"
TEXTS = [None, "", "   \n\t ", "one", "é ü 漢字 🙂", "a b c d e f g", "a b c d e f g", LONG, "\x00\x1c weird ​", "<|end|> </s> GNU General Public License"]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.0, "k", 1, 1, 1, 1) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a row that is repeated as a whole and two rows without an id."""
    return table(spark, [*TEXTS, TEXTS[5], "x", None], [*range(len(TEXTS)), 5, None, None])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_equals_reference(spark, odd, reference_encoding):
    rows = bpe.encode_documents(odd).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        if r["doc_id"] is not None and TEXTS[r["doc_id"]]:
            assert r["ids"] == reference_encoding(TEXTS[r["doc_id"]]) and bytes(r["decoded"]).decode() == TEXTS[r["doc_id"]]
    assert [r["ids"] for r in rows if r["doc_id"] in (0, 1)] == [[], []]
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_ids(spark.createDataFrame([(1, [15496, 995]), (2, None)], "doc_id long, ids array<int>")).collect()}
    assert back == {1: b"Hello world", 2: b""}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip(reference_encoding, text):
    codec = bpe.codec()
    ids = codec.encode(text)
    assert ids == reference_encoding(text) and codec.decode(ids).decode() == text


# --- language identification and quality ---


def test_language_accuracy_on_held_out(spark, docs):
    got = language_id.op1_language_id(spark, DATA)
    held = got.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in held)


def test_language_of_odd_rows(spark, odd, empty, docs):
    model = language_id.fit_languages(docs, F.lit(True))
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(TEXTS) + 3
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and not r["accepted"] for r in rows if r["doc_id"] in (0, 1, 2))
    assert language_id.identify(empty, model).count() == 0
    assert language_id.keep_identified(odd, model).columns == odd.columns
    none = language_id.fit_languages(empty, F.lit(True))
    assert none.languages == [] and {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}


def test_quality_on_held_out(spark):
    got = quality_classifier.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.85


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality_classifier.fit_quality(odd, labels, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score_quality(odd, model).collect())
    assert quality_classifier.score_quality(empty, model).count() == 0


def plain_size(content, text_bytes):
    """Compressed size under a raw dictionary by a fresh compressor for each block."""
    how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=15, search_log=3, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    total = 0
    for i in range(0, len(text_bytes), compression.BLOCK_BYTES):
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=how)
        total += len(zstandard.ZstdCompressor(dict_data=raw, compression_params=how).compress(text_bytes[i : i + compression.BLOCK_BYTES]))
    return total


def test_language_equals_brute_force(spark, docs, texts):
    learn = language_id.crc_mod("doc_id", 3) != 1
    model = language_id.fit_languages(docs, learn, rows_a_language=20, slice_chars=300, dictionary_bytes=5000)
    # Dictionaries hold slices of learned texts of their label only, spread over the texts.
    labelled = {r["doc_id"]: r["lang"] for r in docs.collect()}
    inside, starts = {k: [] for k in model.languages}, []
    for k, content in zip(model.languages, model.dictionaries):
        assert len(content) <= 5000
        own = [language_id.letters_only(t) for d, t in texts.items() if labelled[d] == k and t and zlib.crc32(str(d).encode()) % 3 != 1]
        for part in content.split(b"\n"):
            found = [t.find(part[1:-1]) / max(1, len(t)) for t in own if part[1:-1] in t]
            assert found
            starts += found[:1]
    assert np.quantile(starts, 0.75) > 0.3
    for r in language_id.identify(docs, model).collect():
        text = texts[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        data = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip()
        sizes = [plain_size(c, data) for c in model.dictionaries]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        margin = (sizes[order[1]] - sizes[order[0]]) / max(1, sizes[order[0]])
        assert r["lang_pred"] == model.languages[order[0]] and r["margin"] == pytest.approx(margin)
        assert r["score"] == pytest.approx(1 - 0.5 * np.exp(-margin / model.scale)) and r["accepted"] == (margin >= model.min_margin)


def test_sample_of_repeated_ids_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("id % 3 doc_id", "repeat(cast(id as string), 50) text", "'en' lang")
    model = language_id.fit_languages(rows, F.lit(True), rows_a_language=50)
    assert model.languages == ["en"] and model.dictionaries[0].count(b"\n") <= 2
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.fit_quality(rows, labels, F.lit(True)).good == b""


def test_quality_equals_brute_force(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality_classifier.fit_quality(docs, labels, quality_classifier.crc_mod("doc_id", 5) != 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    used = {1: model.good, 0: model.bad}
    for q, content in used.items():
        own = [texts[d].encode() for d, y in marks.items() if y == q and texts.get(d)]
        parts = content.split(b"\n")
        whole = b"\n".join(own)
        assert all(p in whole for p in parts) and len(content) <= 131072
    assert model.empty_score == pytest.approx((sum(marks.values()) + 1) / (len(marks) + 2))
    a, b = model.weights
    for r in quality_classifier.score_quality(docs.where("doc_id % 7 = 0"), model).collect():
        text = (texts[r["doc_id"]] or "").encode()
        if not text:
            assert r["score"] == model.empty_score
            continue
        x = 20 * (plain_size(model.bad, text) - plain_size(model.good, text)) / len(text)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))))


def test_logistic_regression_fits_the_data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 + 1.5 * x[:, 0])))).astype(float)
    w = quality_classifier._logistic(x, y)
    p = 1 / (1 + np.exp(-(w[0] + w[1] * x[:, 0])))
    assert w == pytest.approx([0.7, 1.5], abs=0.2) and abs((p - y).sum()) < 0.1 and abs(((p - y) * x[:, 0]).sum()) < 0.1


def test_sizes_cover_whole_texts():
    sizer = compression.Sizer([b"abc" * 100, b""])
    assert sizer.sizes(b"") == [0, 0]
    noise = random.Random(1).randbytes(50_000)
    assert all(s > 45_000 for s in sizer.sizes(noise))


# --- licences ---


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(label, i) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found, key=lambda x: (x[1], x[0]))


def test_license_phrases_equal_brute_force(spark):
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "Licensed", "under", "the", "x"]
    rng = random.Random(2)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "CC-BY, cc by", "É cc by"]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert (rows[i]["n_words"], sorted([(p["label"], p["word"]) for p in rows[i]["places"]], key=lambda x: (x[1], x[0]))) == brute_places(text)


def test_license_spans(spark, odd, empty):
    scanner = license_scan.LicenseScanner(license_scan.TEMPLATES, license_scan.PHRASES)
    for label, template in license_scan.TEMPLATES:
        assert scanner.scan("some words " + template)[2] == [(label, 2, len(license_scan.ascii_words(template)) + 1, 1.0)]
    mit = license_scan._MIT
    changed = mit.split()
    changed[20] = "zzz"
    assert [s[0] for s in scanner.scan(" ".join(changed))[2]] == ["mit"]
    assert [s[0] for s in scanner.scan(f"{mit} and then {mit}")[2]] == ["mit", "mit"]
    assert [s[0] for s in scanner.scan("Licensed under CC BY-NC 4.0.")[2]] == ["cc-by-nc-4.0"]
    for text in ("the software is provided to you by a person", "was not released under the MIT terms; licensed under the MIT", "licensed under the Apache License", "Licensed under CC BY-NC terms 4.0"):
        assert scanner.scan(text)[2] == []
    assert license_scan.scan_licenses(odd).count() == len(TEXTS) + 3 and license_scan.scan_licenses(empty).count() == 0


def test_license_spans_survive_edits():
    scanner = license_scan.LicenseScanner(license_scan.TEMPLATES, license_scan.PHRASES)
    words = license_scan._BSD.split()
    for i, j in itertools.combinations(range(0, len(words), 2), 2):
        text = list(words)
        text[i] = text[j] = "zzz"
        assert [s[0] for s in scanner.scan(" ".join(text))[2]] == ["bsd-2-clause"], (i, j)
    whole = f"{license_scan._BSD} {license_scan._BSD_NAMES} {license_scan._BSD_END}".split()
    for i in range(0, len(whole), 7):
        assert [s[0] for s in scanner.scan(" ".join([*whole[:i], "x", "y", *whole[i + 2 :]]))[2]] == ["bsd-3-clause"]


def test_one_word_phrases():
    scanner = license_scan.LicenseScanner([], {"copyleft": "c", "": "none", "all rights": "r"})
    assert scanner.scan("Copyleft") == (1, [("c", 0)], []) and scanner.scan("no") == (1, [], []) and scanner.scan("all rights copyleft")[1] == [("r", 0), ("c", 2)]


def test_matches_and_chains_equal_brute_force():
    rng = random.Random(13)
    for _ in range(150):
        letters = "abcde"[: rng.randint(2, 5)]
        templates = [("t", " ".join(rng.choice(letters) for _ in range(rng.randint(3, 14)))) for _ in range(rng.randint(1, 3))]
        scanner = license_scan.LicenseScanner(templates, {}, min_match=2, min_coverage=0.5, max_gap=4, whole_below=0)
        text = [rng.choice(letters + "z") for _ in range(rng.randint(0, 25))]
        got = {}
        scanner._spans = lambda matches: got.update({k: sorted(v) for k, v in matches.items()}) or []
        scanner.scan(" ".join(text))
        for k, (_, template) in enumerate(templates):
            t = template.split()
            same = lambda a, b: 0 <= a < len(text) and 0 <= b < len(t) and text[a] == t[b]
            want = []
            for a in range(len(text)):
                for b in range(len(t)):
                    if same(a, b) and not same(a - 1, b - 1):
                        n = 1
                        while same(a + n, b + n):
                            n += 1
                        if n >= 2:
                            want.append((a, b, n))
            assert got.get(k, []) == sorted(want)

            def best(chain, covered, rest):
                yield covered
                for i, (a, b, n) in enumerate(rest):
                    if not chain:
                        yield from best((a, b, n), n, rest[i + 1 :])
                    elif b >= chain[1] and a + n > sum(chain[::2]) and b + n > chain[1] + chain[2] and a - sum(chain[::2]) <= 4:
                        yield from best((a, b, n), covered + min(n, b + n - chain[1] - chain[2], a + n - sum(chain[::2])), rest[i + 1 :])

            if want and len(want) <= 12:
                assert max(c for c, _, _ in scanner._chains(want)) == max(best((), 0, sorted(want)))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    automaton = license_scan.SuffixAutomaton(sequences)
    for k in range(1, 8):
        for x in itertools.product(range(3), repeat=k):
            v = 0
            for c in x:
                v = automaton.next[v].get(c) if v is not None else None
            assert (v is not None) == (x in parts)
            if v is not None:
                ends = {(s, e) for s, q in enumerate(sequences) for e in range(k - 1, len(q)) if tuple(q[e - k + 1 : e + 1]) == x}
                assert automaton.ends[v] == ends


# --- fingerprints ---


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**63, 6000).astype(np.uint64), rng.integers(0, 2**63, 3000).astype(np.uint64)
    both = np.concatenate([a[:3000], b])
    x, y = fingerprints.sketch(a), fingerprints.sketch(both)
    assert np.array_equal(fingerprints.merge(fingerprints.sketch(a[:100]), fingerprints.sketch(a[100:])), x)
    assert abs(fingerprints.resemblance(x, y) - 3000 / 9000) < 0.15
    assert abs(fingerprints.containment(y, x) - 0.5) < 0.2
    assert 0.7 < fingerprints.distinct_count(x) / 12000 < 1.4 or 0.7 < fingerprints.distinct_count(x) / 6000 < 1.4
    assert len(fingerprints.sketch(np.concatenate([np.zeros(5000, dtype=np.uint64), a]))) == fingerprints.K
    assert np.array_equal(fingerprints.from_string(fingerprints.to_string(x)), x)


def test_next_document_and_edited_text(spark, texts):
    rows = {r["doc_id"]: r for r in fingerprints.op3_fingerprints(spark, DATA).collect()}
    order = sorted(texts, reverse=True)
    assert len(rows) == len(order)
    for i, d in enumerate(order):
        following = texts[order[(i + 1) % len(order)]]
        third = len(texts[d]) // 3
        edited = texts[d][: len(texts[d]) - third] + following[:third]
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[d]["n_chars"] == len(texts[d])
        a, b = (set(shingles(t).tolist()) for t in (texts[d], edited))
        assert abs(rows[d]["near_edited"] - len(a & b) / len(a | b)) < 0.2


def test_next_of_repeated_and_null_ids(spark):
    """An id of a third of all rows, and rows without an id, are divided over blocks and still follow each other."""
    rng = random.Random(14)
    ids = [rng.choice([7, 7, None, rng.randrange(40)]) for _ in range(600)]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in ids]
    frame = table(spark, texts, ids)
    hashes = {r["text"]: r["h"] for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]], x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        want.append((-1 if d is None else d, len(t), fingerprints.edit(t, order[(i + 1) % len(order)][1])))
    assert sorted(want) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited"]) for r in fingerprints.compare_edited(frame).collect())
    blocks = fingerprints.with_next(frame, block_bytes=500)
    sizes = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    assert len(sizes) > 20 and max(sizes.values()) < 60
    heads = [(r["block"], r["doc_id"], r["text"]) for r in blocks.where("not ahead").collect()]
    assert len(heads) == 600
    tails = {r["block"]: r["text"] for r in blocks.where("ahead").collect()}
    place = {}
    for i, (d, t) in enumerate(order):
        place.setdefault((d, t), i)
    first = {}
    for b, d, t in heads:
        first[b] = min(first.get(b, (10**9, "")), (place[d, t], t))
    full = sorted(first)
    assert [first[b][0] for b in full] == sorted(first[b][0] for b in full)
    assert all(tails[b] == first[full[(i + 1) % len(full)]][1] for i, b in enumerate(full))


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprints.compare_edited(odd).collect()
    assert len(rows) == len(TEXTS) + 3
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (0, 1)}
    assert len(same) == 1 and all(0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.compare_edited(empty).count() == 0 and fingerprints.fingerprint_documents(empty).count() == 0


# --- packing ---


def unpacked(rows, encode, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, text in texts.items():
        ids, at = np.array([*encode(text or ""), packing.END_ID], dtype="<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW and all(r["sequence_length"] == at for r in pieces)
        lengths.append(at)
    return lengths


def test_packing_holds_every_id_once(spark, docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    lengths = unpacked(packing.op5_packing(spark, DATA).collect(), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, texts)
    padding = sum(packing.WINDOW - n for n in lengths if n & (n - 1))
    assert padding < 0.02 * sum(lengths)


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    plain = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y. <|endoftext|", "é  <|endoftext|>  漢字 🙂", "none"]
    assert plain(texts[0]) == [64, 220, 50256, 275]
    assert [packing.vocabulary().encode(t) for t in texts] == [plain(t) for t in texts]
    unpacked(packing.pack(table(spark, texts)).collect(), plain, dict(enumerate(texts)))
    ids = {r["first_doc"]: r["n_ids"] for r in token_output.windows(table(spark, texts[:1])).collect()}
    assert ids == {0: 5}


def test_packing_of_odd_rows(spark, empty):
    rows = packing.pack(table(spark, TEXTS).coalesce(1)).collect()
    unpacked(rows, packing.vocabulary().encode, dict(enumerate(TEXTS)))
    assert packing.pack(empty).count() == 0
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert order == sorted(order)


def least_cost(n, penalty_at, window):
    """Cost of the best plan over all places of a stream, every one of which may be a cut."""
    best = np.zeros(n + 1)
    for b in range(1, n + 1):
        a = np.arange(max(0, b - window), b)
        best[b] = (best[a] + window - (b - a)).min() + penalty_at[b]
    return best[n]


def cost_of(cuts, penalty_at, window):
    starts = [0, *cuts[:-1]]
    assert all(0 < b - a <= window for a, b in zip(starts, cuts))
    return sum(window - (b - a) + penalty_at[b] for a, b in zip(starts, cuts))


@pytest.mark.parametrize("window, longest, rounds", [(16, 9, 200), (16, 60, 100), (packing.WINDOW, 60, 3), (packing.WINDOW, 1500, 6)])
def test_cuts_are_optimal(window, longest, rounds):
    rng = random.Random(window + longest)
    for _ in range(rounds):
        places = np.cumsum([rng.randint(1, longest) for _ in range(rng.randint(1, 4 * window // longest + 20))]).tolist()
        penalties = [0.0 if rng.random() < 0.2 else packing.SENTENCE_CUT for _ in places]
        penalty_at = dict.fromkeys(range(places[-1] + 1), packing.FREE_CUT) | dict(zip(places, penalties))
        plan = packing.Plan(window)
        plan.extend(places, penalties)
        cuts = plan.cuts()
        assert cuts[-1] == places[-1] and cost_of(cuts, penalty_at, window) == pytest.approx(least_cost(places[-1], penalty_at, window))


@pytest.mark.parametrize("block", [300, 1000, 5000])
def test_blocks_give_the_plan_of_the_whole_stream(block):
    rng = np.random.default_rng(12)
    ends_sentence = np.zeros(100, dtype=bool)
    ends_sentence[:4] = True
    docs = [rng.integers(0, 100, rng.integers(1, 400)).astype(np.uint32) for _ in range(200)]
    window, packer, pieces = 256, packing.Packer(ends_sentence, 256, block), []
    for d, ids in enumerate(docs):
        packer.add(d, ids)
        if packer.is_due():
            pieces += packer.take(False)
    given = len(pieces)
    pieces += packer.take(True)
    assert given > 0.3 * len(pieces)
    lengths = {p[5]: p[7] for p in pieces}
    stream, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    penalty_at = np.full(len(stream) + 1, packing.FREE_CUT)
    penalty_at[np.flatnonzero(ends_sentence[stream]) + 1] = packing.SENTENCE_CUT
    penalty_at[ends] = 0.0
    cuts = np.cumsum([lengths[k] for k in sorted(lengths)])
    assert cuts[-1] == len(stream)
    # The last sequence may be split further, where that costs less than its padding.
    assert cost_of(cuts.tolist(), penalty_at, window) - window * 8 <= least_cost(len(stream), penalty_at, window)
    whole = packing.Packer(ends_sentence, window, 10**9)
    for d, ids in enumerate(docs):
        whole.add(d, ids)
    assert pieces == whole.take(True)


def test_tail_is_split_into_powers_of_two():
    assert packing.split_tail(1000) == [1000] and packing.split_tail(600) == [512, 64, 16, 8] and packing.split_tail(512) == [512]


# --- near duplicates ---


def brute_classes(texts, idf, threshold):
    first, parent = {}, {}
    for d in sorted(texts):
        first.setdefault(texts[d] or "", d)
    sets = {d: (s[0], near_dedup.weigh(*s, idf)) for t, d in first.items() for s in [near_dedup.counted_shingles(t)]}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if near_dedup.weighted_jaccard(sets[a], sets[b]) >= threshold:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(first[t or ""]) for d, t in texts.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for copy in range(rng.choice([1, 1, 2, 3, 4])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 12])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(words)
    docs = table(spark, list(texts.values())).withColumn("text", F.col("text"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts, near_dedup.document_frequencies(docs), near_dedup.THRESHOLD)
    kept = near_dedup.keep_heads(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_large_group_is_one_class(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(1000)}" for _ in range(200)]
    texts = [" ".join(base[:i] + [f"n{i}"] + base[i + 1 :]) for i in range(150)] + [" ".join(base)] * 60
    rows = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert {r["class_id"] for r in rows} == {0} and sum(r["is_head"] for r in rows) == 1


def group_without_centre(size=500, places=30):
    """Copies of one text, each with three of some places changed: those that share two places are near duplicates."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(1000)}" for _ in range(220)]
    texts = []
    for k in range(size):
        words = list(base)
        for at in rng.sample(range(places), 3):
            words[7 * at + 5] = f"n{k}x{at}"
        texts.append(" ".join(words))
    return texts


def test_large_group_without_centre_equals_brute_force(spark):
    texts = group_without_centre()
    docs = table(spark, texts)
    want = brute_classes(dict(enumerate(texts)), near_dedup.document_frequencies(docs), near_dedup.THRESHOLD)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_large_group_does_not_depend_on_partitions(spark, partitions):
    texts = group_without_centre(size=300, places=24)
    docs = table(spark, texts)
    want = brute_classes(dict(enumerate(texts)), near_dedup.document_frequencies(docs), near_dedup.THRESHOLD)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert got == want


def families(size, count, places=30, changes=3):
    """Copies of several versions of one text, versions being alike but for eight words; copies differ in some places each."""
    rng = random.Random(15)
    base = [f"w{rng.randrange(1000)}" for _ in range(270)]
    texts = []
    for k in range(size):
        words = list(base)
        for at in range(8):
            words[220 + 6 * at] = f"v{k % count}x{at}"
        for at in rng.sample(range(places), changes):
            words[7 * at + 5] = f"n{k}x{at}"
        texts.append(" ".join(words))
    return texts


def dense_classes(texts, idf, threshold):
    """Classes by comparing all pairs, as a matrix: for texts whose shingles are all different."""
    sets = [near_dedup.counted_shingles(t) for t in texts]
    assert all((c == 1).all() for _, c in sets)
    weights = [near_dedup.weigh(*x, idf) for x in sets]
    every, n = np.unique(np.concatenate([h for h, _ in sets]), return_counts=True)
    shared = every[n > 1]
    inside = np.zeros((len(texts), len(shared)), dtype=np.float32)
    for i, (h, _) in enumerate(sets):
        inside[i, np.searchsorted(shared, h[np.isin(h, shared)])] = 1
    of = near_dedup.weigh(shared, np.ones(len(shared)), idf).astype(np.float32)
    total = np.array([w.sum() for w in weights])
    both = (inside * of) @ inside.T
    alike = both / (total[:, None] + total[None, :] - both) >= threshold
    label = np.full(len(texts), -1)
    for i in range(len(texts)):
        todo = [i] if label[i] < 0 else []
        while todo:
            label[todo] = i
            todo = np.flatnonzero(alike[todo].any(axis=0) & (label < 0)).tolist()
    return label.tolist(), int(np.triu(alike, 1).sum())


@pytest.mark.parametrize("partitions", ["4", "64"])
def test_five_thousand_copies_equal_brute_force(spark, partitions):
    """Large buckets that hold several classes, all pairs of which are near the threshold."""
    texts = families(5000, 2)
    docs = table(spark, texts)
    want, pairs = dense_classes(texts, near_dedup.document_frequencies(docs), near_dedup.THRESHOLD)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    same = sum(got[i] == want[i] for i in range(len(want))) / len(want)
    print(f"{pairs} linked pairs, {len(set(want))} classes, {same:.4f} of the documents in the right class")
    assert 1 < len(set(want)) and same == 1


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS) + 3
    by = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert by[0] == by[1] == 0 and by[5] == by[6] == 5 and by[7] == 7
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in near_dedup.keep_heads(odd).collect()]
    assert kept.count(5) == 1 and 6 not in kept and kept.count(None) == 1


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2)
    h = np.unique(h)
    w = rng.uniform(1, 2, len(h))
    a, b = (h[:700], w[:700]), (h[200:], w[200:])
    x, y = (np.frombuffer(near_dedup.sampler().sample(*s), dtype="<u4") for s in (a, b))
    assert abs((x == y).mean() - near_dedup.weighted_jaccard(a, b)) < 0.25
    assert (np.frombuffer(near_dedup.sampler().sample(*a), dtype="<u4") == x).all()


def test_components(spark, tmp_path):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 101)], "a long, b long")
    labels = {r["nid"]: r["label"] for r in near_dedup.components(chain, f"file://{tmp_path}").collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}


# --- chat ---

PIECES = st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "<", "|", "end|>", "<\\|end|>", "a", " ", "\n", "é", "🙂"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escapes_are_reversible(text):
    inside = chat_format.escape(text)
    assert chat_format.unescape(inside) == text and not any(c in inside for c in chat_format.CONTROL)
    rendered, _ = chat_format.render([("user", text), (text, text)])
    assert chat_format.read_turns(rendered) == [("user", text), (text, text)]


def test_conversations(spark, monkeypatch):
    turns = [(1, 0, "user", "hi\n"), (1, 1, "assistant", "\n there </s>"), (1, 2, "assistant", None), (2, 1, "assistant", "🙂 é <|end|>"), (2, 0, None, "x"), (None, 0, "assistant", "n"), (3, 0, "user", ""), *chat_format.EXTRA]
    frame = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, mask int")
    rows = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(frame)).collect()}
    assert len(rows) == 5
    for conv, r in rows.items():
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        said = "".join(t for _, role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(frame.limit(0))).count() == 0


def test_long_conversation_is_formatted_in_parts(spark):
    frame = spark.range(400).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('word é ', 1000) text")
    out = chat_format.format_conversations(frame)
    assert out.count() > 1
    r = chat_format.digests(out).first()
    said = "word é " * 1000 * 200
    assert r["n_turns"] == 400 and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_parts_are_encoded_like_the_whole():
    """A marker is a token of its own, so a conversation that is encoded in parts gets the ids and mask of one encoding."""
    rng, chat = random.Random(16), chat_format.encoder()
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", ""]), "".join(rng.choice(["a", " b", "\n", "é", "🙂", "word ", "<|end|>", " "]) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(2, 8))]

        def encoded(some):
            text, spans = chat_format.render(some)
            ids, offsets = chat.encode(text)
            return ids.tolist(), chat_format.token_mask(offsets, [x[:2] for x in spans if x[2] == "assistant"]).tolist()

        cut = rng.randint(1, len(turns) - 1)
        (ids, mask), (a, b), (c, d) = encoded(turns), encoded(turns[:cut]), encoded(turns[cut:])
        assert ids == a + c and mask == b + d


def test_mask_equals_plain_intersection():
    rng = random.Random(9)
    for _ in range(200):
        edges = sorted(rng.sample(range(60), 2 * rng.randint(0, 6)))
        spans = list(zip(edges[::2], edges[1::2]))
        cuts = [0, *sorted(rng.sample(range(1, 60), rng.randint(0, 20))), 60]
        offsets = np.array(list(zip(cuts, cuts[1:])))
        want = [any(a < e and s < b for s, e in spans) for a, b in offsets]
        assert chat_format.token_mask(offsets, spans).tolist() == want


# --- token shards ---


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        slots = token_output.feistel(np.arange(n), n, 7)
        assert sorted(slots.tolist()) == list(range(n))
    assert token_output.feistel(np.arange(1000), 1000, 7).tolist() != token_output.feistel(np.arange(1000), 1000, 8).tolist()


def brute_order(docs, key):
    """Windows in training order: slot to (ids, first document, start), from the partitions of the documents."""
    windows = []
    for rows in docs.rdd.glom().collect():
        stream = [(i, r["doc_id"], k) for r in rows for k, i in enumerate([*(packing.vocabulary().encode(r["text"]) if r["text"] else []), 0])]
        for k in range(0, len(stream), token_output.WINDOW):
            some = stream[k : k + token_output.WINDOW]
            windows.append(([x[0] for x in some], some[0][1], some[0][2]))
    slots = token_output.feistel(np.arange(len(windows)), len(windows), key)
    return dict(zip(slots.tolist(), windows))


def test_shards_hold_every_window(spark, docs, tmp_path):
    path, some = f"file://{tmp_path}/a", docs.repartition(3, "doc_id")
    rows = sorted(token_output.materialise(some, path, shard_slots=50).collect(), key=lambda r: r["slot"])
    want = brute_order(some.select("doc_id", "text"), 7)
    assert [r["slot"] for r in rows] == list(range(len(want))) and len(want) > 150
    for r in rows:
        ids, first, start = want[r["slot"]]
        padded = np.array(ids + [0] * (token_output.WINDOW - len(ids)), dtype="<u2")
        assert (r["n_ids"], r["first_doc"], r["start"]) == (len(ids), first, start) and r["ids_crc32"] == zlib.crc32(padded.tobytes())
        assert (r["shard"], r["byte_at"]) == (r["slot"] // 50, r["slot"] % 50 * token_output.STRIDE)
    shards = f"{path}/shards-7-50"
    back = {r["slot"]: r["ids"] for r in token_output.read_shards(spark, shards, shard_slots=50).collect()}
    assert all(back[s][: len(ids)] == ids for s, (ids, _, _) in want.items())
    late = token_output.read_shards(spark, shards, 77, shard_slots=50)
    assert sorted(r["slot"] for r in late.collect()) == list(range(77, len(rows)))
    assert "PartitionFilters: [isnotnull(shard" in late._jdf.queryExecution().toString()


def overwrite(file, content):
    file.with_name(f".{file.name}.crc").unlink()  # Hadoop's checksum of the local file
    file.write_bytes(content)


def test_broken_run_is_resumed(spark, docs, tmp_path):
    path = f"file://{tmp_path}/a"
    rows = sorted(map(tuple, token_output.materialise(docs, path, shard_slots=50).collect()))
    folder = tmp_path / "a" / "shards-7-50"
    files = {int(f.parent.name.split("=")[1]): f for f in folder.glob("shard=*/part-*")}
    whole = {k: f.read_bytes() for k, f in files.items()}
    assert len(whole) >= 4
    (folder / "_SUCCESS").unlink()
    files[1].unlink()
    overwrite(files[3], whole[3][:-token_output.STRIDE])
    lost = token_output.checked_shards(spark, f"file://{folder}").where("slot between 50 and 99")
    assert lost.count() == 0
    assert sorted(map(tuple, token_output.materialise(docs, path, shard_slots=50).collect())) == rows
    again = {int(f.parent.name.split("=")[1]): f for f in folder.glob("shard=*/part-*")}
    assert {k: f.read_bytes() for k, f in again.items()} == whole
    assert {k for k in again if again[k] != files[k]} == {1, 3}  # the others' files are those of the first run
    files = list(folder.glob("shard=2/part-*"))
    broken = bytearray(files[0].read_bytes())
    broken[token_output.HEAD + 5] ^= 1
    overwrite(files[0], bytes(broken))
    changed = [r for r, w in zip(sorted(map(tuple, token_output.materialise(docs, path, shard_slots=50).collect())), rows) if r != w]
    assert len(changed) == 1 and changed[0][0] == 100  # the result is of what stands in the shards


def test_shards_of_odd_rows(spark, odd, empty, tmp_path):
    assert token_output.materialise(odd, f"file://{tmp_path}/a").where("ids_crc32 is not null").count() > 0
    assert token_output.materialise(empty, f"file://{tmp_path}/b").count() == 0


# --- quality rules ---


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {p + k for p, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(places)


def test_rules_equal_brute_force(spark, odd, empty):
    rng = random.Random(10)
    made = ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "\xa0", "🙂"]) for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", "\n\n", "a b a b a b"]
    rows = {r["doc_id"]: r for r in quality_rules.ledger(table(spark, made)).collect()}
    for i, text in enumerate(made):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(text)
    assert quality_rules.ledger(odd).count() == len(TEXTS) + 3 and quality_rules.ledger(empty).count() == 0
    kept = quality_rules.keep_by_rules(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert quality_rules.keep_by_rules(table(spark, [" ".join(f"word{i}" for i in range(60))])).count() == 1


def test_ablation(spark):
    rows = quality_rules.ledger(table(spark, ["one two", "a b c " * 40, " ".join(f"w{i}" for i in range(60))]))
    got = {(r["policy"], r["rule"]): (r["n_failed"], r["n_only"]) for r in quality_rules.ablation(rows).collect()}
    assert got["base", "few_words"] == (1, 1) and got["base", "repeated_windows"] == (1, 1)
    assert quality_rules.verdicts(rows, "base").where("kept").count() == 1


def test_rules_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(quality_rules.ORACLE).fetchall()
    got = [tuple(r) for r in quality_rules.op9_quality_rules(spark, DATA).collect()]
    assert sorted(got) == sorted(want)
