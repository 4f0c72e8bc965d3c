"""Document operators on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm import bpe, langid, licenses, lm, packing, pii, quality_classifier, simhash

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "score double, fingerprint string, component_id long, ids array<int>, lang_pred string, fp long, row long, n long"


@pytest.fixture(scope="module")
def awkward(spark):
    rnd = random.Random(1)
    word = lambda k: "".join(rnd.choices("abcdefghij", k=k))
    base = " ".join(word(rnd.randint(1, 9)) for _ in range(300))
    near = base.replace(base.split()[150], "changed", 1)
    texts = [
        None, "", " \n\t ", "one", "One TWO", base, base, near, base.upper(), "x" * 5000, " ".join(["Éa"] * 9000),
        "a  b\n\nc", "<|endoftext|> end", "mail a.b@c.org, +1 (222) 333-4444 or 4111 1111 1111 1111 at 10.0.0.1", "日本語のテキスト", "!!! 123",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), 0.5, "f", 7, [1], "zz", 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "without an id", "en", None, 1, 0.5, "f", 7, [1], "zz", 3, 4, 5)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="module")
def prose(spark):
    rnd = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "her", "and"], "fr": ["eau", "ment", "oi", "que", "les"], "de": ["sch", "ung", "ein", "heit", "der"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        words = ["".join(rnd.choices(parts[lang], k=rnd.randint(1, 3))) for _ in range(80)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in words), lang, int(not bad)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(9999, 1), (None, 1), (3, None)], "doc_id long, quality int")
    return docs, labels


def empty(spark, frame):
    return spark.createDataFrame([], frame.schema)


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, awkward):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
    ids = [i for i in prints if i is not None]
    reach = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    reach[a] = reach[b] = min(reach[a], reach[b])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == reach
    assert simhash.near_duplicates(empty(spark, awkward)).count() == 0


@pytest.mark.parametrize("parts", [5, 6, 7])
def test_golay_keys_lose_no_link(parts):
    column, error = simhash._golay()
    assert len(set(error.tolist())) == 2048 and sorted(map(int.bit_count, error.tolist()))[-1] == 3
    rng = np.random.default_rng(0)
    one = rng.integers(0, 1 << 63, 3000).astype(np.int64)
    two = one.copy()
    for i in range(len(two)):
        for b in rng.choice(63, rng.integers(0, 5), replace=False):
            two[i] ^= np.int64(1) << np.int64(b)
    keys = [[set() for _ in one], [set() for _ in one]]
    for side, values in enumerate((one, two)):
        for at, key in zip(*simhash.fuzzy_keys(values, parts), strict=True):
            keys[side][at].add(int(key))
    assert all(a & b for a, b in zip(*keys, strict=True))
    assert max(map(max, keys[0])) < 1 << 62


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.segments_for(n) for n in (0, 10**6, 10**9, 10**11)] == [5, 5, 6, 7]


def test_forest_and_blocks_join_all_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    values = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (200, 2)) if a != b}
    values |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    rows = np.array(sorted(values), np.int64)
    near = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}
    from inkstone.llm.common import Scratch
    from inkstone.llm.components import connected_components

    def classes(edges):
        up = {v: v for v in values}
        for _ in values:
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert classes(simhash.forest(rows)) == classes(near)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    frame = spark.createDataFrame([(int(v),) for v in rows], "fp long")
    scratch = Scratch(spark)
    links = simhash.fingerprint_links(frame, scratch)
    found = {r["node"]: r["component"] for r in connected_components(links, scratch).collect()}
    assert {v: found.get(v, v) for v in values} == classes(near)
    found = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(frame, scratch, 6), scratch).collect()}
    assert {v: found.get(v, v) for v in values} == classes(near)


@pytest.fixture(scope="module")
def copies(spark):
    """Forty texts, each with near copies at several distances, exact copies and rows that repeat."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefghijkl", k=rnd.randint(2, 8)))
    rows = []
    for i in range(40):
        base = [word() for _ in range(rnd.choice((60, 150, 400)))]
        for k in range(rnd.choice((1, 2, 25))):
            words = list(base)
            for _ in range(rnd.randint(0, 2) * len(base) // 150):
                words[rnd.randrange(len(words))] = word()
            rows.append((1000 * i + k, " ".join(words)))
    rows += [(90_000, None), (90_001, ""), (90_002, " \n"), (90_003, "one"), (90_004, "ONE"), rows[3], rows[3]]
    rnd.shuffle(rows)
    return rows


def test_similar_texts_like_all_pairs(spark, copies):
    texts = {}
    for i, text in sorted(copies, key=lambda r: r[0]):
        texts.setdefault(i, text)
    sets = {i: set(map(tuple, zip(*([(t or "").lower().split()[k:] for k in range(5)])))) or {tuple((t or "").lower().split())} for i, t in texts.items()}
    want, stand = {}, []
    for i in sorted(sets):
        near = [j for j in stand if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        want[i] = near[0] if near else i
        stand += [] if near else [i]
    frame = spark.createDataFrame(copies, "key long, text string")
    for rule in (simhash.Rule(), simhash.Rule(texts=4, characters=1_000_000_000), simhash.Rule(characters=4000)):
        got = simhash.similar(frame, "key", rule=rule).collect()
        assert len(got) == len(copies)
        assert sum(r["leader"] == want[r["key"]] for r in got) >= 0.98 * len(got)
        for r in got:
            assert r["leader"] == r["key"] or len(sets[r["key"]] & sets[r["leader"]]) >= 0.8 * len(sets[r["key"]] | sets[r["leader"]])
    assert {r["key"]: r["leader"] for r in got if r["key"] >= 90_000} == {90_000: 90_000, 90_001: 90_000, 90_002: 90_000, 90_003: 90_003, 90_004: 90_003}
    assert simhash.similar(spark.createDataFrame([], "key long, text string"), "key").count() == 0


def test_similarity_of_sets():
    a, b = np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert simhash.jaccard(a, b, 0.8) == 0.9 and simhash.jaccard(a, b[:5], 0.8) == 0.0 and simhash.jaccard(a[:0], b[:0], 0.8) == 1.0
    assert len(simhash.shingle_set("a b c d e f", 5)) == 2 and len(simhash.shingle_set("a b", 5)) == 1 and len(simhash.shingle_set(None, 5)) == 0
    prints = simhash.word_prints(b"a b c d".split(), 3)
    assert len(set(prints)) == 3 and prints == simhash.word_prints(b"d c b a a".split(), 3) and simhash.word_prints([], 2) == [0, 0]


def test_components_of_chains_and_none(spark):
    from inkstone.llm.common import Scratch
    from inkstone.llm.components import connected_components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()
    assert {r["node"]: r["component"] for r in found} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert len(found) == 43
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_bpe_round_trip(spark, awkward):
    library = Tokenizer.from_file(PATH)
    got = bpe.digests(awkward, PATH).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    assert len(got) == awkward.count()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(awkward.select("doc_id", "text"), PATH), PATH).collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)
    assert bpe.digests(empty(spark, awkward), PATH).count() == 0


def test_bpe_like_the_library_on_odd_texts():
    library, own = Tokenizer.from_file(PATH), bpe.Codec(bpe.read_vocabulary(PATH))
    rnd = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", " ", " ", "\x85", "\x1c", "1", "²", "!", "...", "日本", "👩‍👩‍👧", "<|endoftext|>", "́", "\x00", "a" * 40, "ab" * 300, ",", "Word,"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(3000)]
    assert own.encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = [[rnd.randrange(own.width) for _ in range(20)] for _ in range(500)]
    assert [own.decode(i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]
    word = b"ab" * 300
    assert own.merge_long(word) == np.array(library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_places_everything(spark, awkward):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(awkward, PATH).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.where("doc_id <> 5").collect()}
    for doc_id, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        own = rows[rows.doc_id == doc_id].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    rows = rows.sort_values(["sequence_id", "offset"])
    end = rows.offset + rows.length
    assert (end.groupby(rows.sequence_id).shift(1).fillna(0) == rows.offset).all() and end.max() <= 1024
    assert packing.pack_documents(empty(spark, awkward), PATH).count() == 0


def test_best_fit_obeys_every_capacity():
    rnd = random.Random(5)
    counts = {n: rnd.randint(1, 60) for n in range(1, 101)}
    bound = [set() for _ in range(3)]
    plain = packing.Capacity(100, 100, 10_000, 1)
    for room in (plain, packing.Capacity(100, 4, 3000, 1, (1.0, 0.5, 0.5), "dot"), packing.Capacity(100, 3, 10_000, 1), packing.Capacity(100, 16, 10_000, 25), packing.Capacity(100, 5, 10_000, 10, (1.0, 0.2, 0.2))):
        some = {n: c for n, c in counts.items() if room.need(n)[2] <= room.attention}
        used, seen = {}, {}
        for r in packing.plan(some, room).itertuples():
            for k in range(r.count):
                seen.setdefault(r.length, []).append(r.first + k)
                used.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
        assert all(sorted(seen[n]) == list(range(c)) for n, c in some.items())
        for own in used.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
            use = sum(room.need(n) for _, n in own)
            assert (use <= (room.tokens, room.documents, room.attention)).all() and use[0] == sum(n for _, n in own) and use[1] == len(own)
            for k, most in enumerate((room.tokens, room.documents, room.attention)):
                if use[k] == most:
                    bound[k].add(room)
    assert all(bound) and packing.Capacity().need(1024)[2] == packing.Capacity().attention and packing.Capacity().need(3)[2] == 64 * 64
    total = sum(n * c for n, c in counts.items())
    places = packing.plan(counts, plain)
    sequences = (places.sequence + (places["count"] - 1) // places.each).max() + 1
    assert sequences <= -(-total // 100) * 1.02 + 2


def test_quality_classifier(spark, prose, awkward):
    docs, labels = prose
    rows = quality_classifier.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    odd = quality_classifier.classify(awkward, labels).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    none = quality_classifier.classify(docs, empty(spark, labels)).collect()
    assert len(none) == 240 and len({r["score"] for r in none}) == 1
    assert quality_classifier.classify(empty(spark, docs), labels).count() == 0


def test_scores_like_plain_compression(spark, prose):
    """Every score from the model's dictionaries and curve, by plain calls; the dictionaries have seen whole texts."""
    import zstandard

    docs, labels = prose
    docs = docs.withColumn("text", F.repeat("text", 20))
    model = quality_classifier.fit(docs, labels)
    assert model.slope > 0 and model.bad and model.good
    tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.bad, model.good)]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_classifier.score(docs, model).collect():
        data = texts[r["doc_id"]].encode()
        sizes = [sum(len(t.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for t in tools]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-((sizes[0] - sizes[1]) / (len(data) + 50) * model.slope + model.offset))))
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_samples_are_whole_texts(spark):
    from inkstone.llm.common import whole_sample

    rows = [(i, "x" * (10 * i + 1)) for i in range(60)] + [(5, "a"), (7, "x" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = spark.createDataFrame([(i % 2, i) for i in range(80)], "g int, doc_id long")
    texts = {i: min(t for j, t in rows if j == i) for i, _ in rows}
    got = whole_sample(docs, groups, {0: 40, 1: 40}, "g", 1000, 10**6).collect()
    assert {r["doc_id"]: r["text"] for r in got} == texts and len(got) == 60
    few = whole_sample(docs, groups, {0: 40, 1: 40}, "g", 12, 10**6).collect()
    assert [sum(r["g"] == g for r in few) for g in (0, 1)] == [12, 12] and all(r["text"] == texts[r["doc_id"]] for r in few)
    small = whole_sample(docs, groups, {0: 40, 1: 40}, "g", 1000, 500).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in small) and all(0 < sum(len(r["text"]) for r in small if r["g"] == g) <= 500 for g in (0, 1))


def test_language_id(spark, prose, awkward):
    docs, _ = prose
    rows = langid.identify_documents(docs).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 30 and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.95
    odd = {r["doc_id"]: r for r in langid.identify_documents(awkward).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, 15)] == ["und"] * 4 and odd[5]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    unlearned = langid.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}
    assert langid.identify_documents(empty(spark, docs)).count() == 0


def test_kneser_ney_by_blocks_and_sums():
    texts = {"a": [langid.fold("abab abba baba " * 9)], "b": [langid.fold("cdcd ccdd dcdc " * 9)]}
    model = langid.train(texts, langid.Settings())
    whole, n = langid.entropies(model, ["abba baba abab cd " * 40, "", "12"], 1 << 19)
    parts, _ = langid.entropies(model, ["abba baba abab cd " * 40, "", "12"], 64)
    assert np.allclose(whole, parts, rtol=1e-5) and n.tolist()[1:] == [0, 0] and whole[0, 0] < whole[0, 1]
    letters = [32, *map(ord, "abcd"), ord("z")]
    for context in ("", "a", "ab ", "cd c", "zz"):
        base = np.r_[np.full(4, 32, np.uint32), np.array([ord(c) for c in context], np.uint32)]
        total = sum(np.exp(langid.log_likelihoods(model, np.r_[base, np.uint32(c)])[-1]) for c in letters)
        assert np.allclose(total, 1, atol=1e-5)


def plain_kneser_ney(text, letters, order):
    """P(letter | context) from counted strings, by the recursion as it is written."""
    padded = " " * order + text
    grams = lambda n: [padded[i - n + 1 : i + 1] for i in range(order, len(padded))]
    counts = {order: {}}
    for g in grams(order):
        counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {g: 0 for g in grams(n)}
        for g in set(grams(n + 1)):
            counts[n][g[1:]] += 1
    discount = {}
    for n, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)

    def p(letter, context):
        n = len(context) + 1
        some = {g: v for g, v in counts[n].items() if g[:-1] == context}
        lower = p(letter, context[1:]) if context else 1 / (letters + 1)
        if not some:
            return lower
        total = sum(some.values())
        return max(some.get(context + letter, 0) - discount[n], 0) / total + discount[n] * len(some) / total * lower

    return p


def test_kneser_ney_like_the_recursion():
    texts = {"a": "abab abba baba aab " * 3, "b": "cdcd ccdd dcdc "}
    settings = langid.Settings()
    model = langid.train({k: [langid.fold(v)] for k, v in texts.items()}, settings)
    for k, name in enumerate(model.languages):
        p = plain_kneser_ney(langid.fold(texts[name]).astype("<u4").tobytes().decode("utf-32-le"), 5, settings.order)
        for asked in (" abba ab ", " cddc ", " azb ", " ccab "):
            got = langid.log_likelihoods(model, np.r_[np.full(4, 32, np.uint32), langid.fold(asked)])[:, k]
            padded = " " * 4 + langid.fold(asked).astype("<u4").tobytes().decode("utf-32-le")
            assert np.allclose(got, [np.log(p(padded[i], padded[i - 3 : i])) for i in range(4, len(padded))], atol=1e-4)


def test_rejection_lies_between_known_and_other_languages():
    rnd = random.Random(9)
    draw = lambda parts, n: " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(n))
    kinds = {"en": ["the", "ing", "tion", "her", "and"], "fr": ["eau", "ment", "oi", "que", "les"], "de": ["sch", "ung", "ein", "heit", "der"]}
    s = langid.Settings()
    learned = {k: [langid.fold(draw(kinds[k], 300)) for _ in range(10)] for k in ("en", "fr")}
    judge = [(k, langid.fold(draw(kinds[k], 300))) for k in ("en", "fr") for _ in range(20)]
    model = langid.calibrated(langid.train(learned, s), judge, s)
    assert [n for n, _ in model.highest][:3] == [8, 16, 32]
    for k, far in (("en", False), ("fr", False), ("de", True)):
        texts = [draw(kinds[k], n) for n in (20, 60, 200) for _ in range(20)]
        mean, number = langid.entropies(model, texts, s.block)
        rejected = langid.beyond(model, number, mean.min(axis=1))
        assert rejected.mean() >= 0.9 if far else not rejected.any()
    assert not langid.beyond(model, np.array([3]), np.array([99.0])).any()


LICENCE_FORMS = {
    "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
    "Foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GPL-3.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GPL-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n"
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "LGPL-2.1",
    "This library is released under the MIT license.": "MIT",
    "Distributed under the terms of the MIT license, see LICENSE.": "MIT",
    "The whole of this code is available under the Apache License, Version 2.0": "Apache-2.0",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "# SPDX-License-Identifier: GPL-2.0-or-later AND MIT": "GPL-2.0,MIT",
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "(1) Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "(2) Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    "(3) Neither the name of the Foo Bar project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    "This is not released under the MIT license.": None,
    "We talk of free software: you can redistribute it at will.": None,
    "See the MIT license text in the file of that name, which is long.": None,
}


def test_licence_sentences_with_names_and_marks(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LICENCE_FORMS)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert [got.get(i) for i in range(len(LICENCE_FORMS))] == [*LICENCE_FORMS.values()]


def test_language_model(spark, awkward):
    rnd = random.Random(4)
    chain = {"a": "b", "b": "c", "c": "d", "d": "a"}
    rows = []
    for i in range(1500):
        w, words = rnd.choice("abcd"), []
        for _ in range(rnd.randint(5, 60)):
            words.append(w)
            w = chain[w] if rnd.random() < 0.9 else rnd.choice("abcd")
        rows.append((i, " ".join(words) + (" rare%d" % i if i % 50 == 0 else "")))
    edge = ["\u00a0foo bar", "foo", "foo\u3000 \x1cfoo\x1d foo\u0085", "\u3000", "hot " * 300, "x\u00a0", "\u2003hot\u2003 hot"]
    rows += [(1500 + i, edge[i % len(edge)]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = lm.Settings(slices=4, window=8, lanes=16, rate=0.02, known=8, groups=64, replica_tokens=4000, fan=2)
    got = lm.score_documents(docs, settings).toPandas().set_index("doc_id")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = {}
    for _, text in learned:
        for w in [*re.findall(r"[^\x20\x09-\x0D]+", text), ""]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        words = [*re.findall(r"[^\x20\x09-\x0D]+", text), ""]
        assert got.n_tokens[i] == len(words) and got.n_known[i] == sum(w in counts for w in words)
        assert got.base_score[i] == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words))
    held = got[got.held_out & (got.index < 1500)]
    assert (got.train_tokens == n).all() and held.score.sum() > 0.9 * held.base_score.sum()
    odd = lm.score_documents(awkward).collect()
    assert len(odd) == awkward.count() and all(r["score"] < 0 for r in odd)
    assert lm.score_documents(empty(spark, docs)).count() == 0


def test_columns_with_points_and_many_languages(spark):
    rows = [(i, f"lang {i % 700} " + " ".join(chr(97 + (i % 700 + k) % 26) * 3 for k in range(12)), f"l{i % 700:03d}") for i in range(2800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("a.b", F.lit(1))
    model = langid.fit(docs)
    learnt = {f"l{i % 700:03d}" for i in range(2800) if zlib.crc32(str(i).encode()) % 5}
    assert set(model.languages) == learnt and len(learnt) > 690
    assert langid.identify(docs.limit(3), model).where("`a.b` = 1").count() == 3
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    scored = quality_classifier.score(docs.limit(3), quality_classifier.fit(docs, labels))
    assert scored.columns == ["doc_id", "text", "lang", "a.b", "score", "predicted"] and scored.count() == 3


def test_language_model_learns_from_every_row(spark):
    """One id for half of the rows, null for the others: slices and replicas still share them evenly."""
    docs = spark.range(1600).selectExpr("if(id % 2 = 0, 8, NULL) AS doc_id", "repeat('a b c d ', 12) AS text")
    s = lm.Settings(window=8, lanes=16, rate=0.02, slices=4)
    counts = lm.count_words(docs)
    rows = lm.encode(docs, lm.vocabulary_of(counts, s), s).groupBy("slice").count().collect()
    assert sorted(r["slice"] for r in rows) == [0, 1, 2, 3] and min(r["count"] for r in rows) > 300
    got = lm.score_documents(docs, s).toPandas()
    assert not got.held_out.any() and got.score.sum() > 0.6 * got.base_score.sum()


def test_language_model_sums_to_one_and_carries_state(spark):
    s = lm.Settings(head=14, groups=7, class_words=6, embedding=3, hidden=4)
    network = lm.Network(np.arange(30, 9, -1), s)
    rng = np.random.default_rng(0)
    network.weights = {k: v + rng.normal(0, 0.3, v.shape) for k, v in network.weights.items()}
    state = rng.normal(0, 1, (1, 4))
    assert np.exp(network.log_p(np.repeat(state, 21, 0), np.arange(21))).sum() == pytest.approx(1)
    texts = spark.createDataFrame([(i, f"w{i} x{i % 9} y z z z") for i in range(60)], "doc_id long, text string")
    counts = lm.count_words(texts)
    known = lm.vocabulary_of(counts, s)
    words = {r["word"]: r["n"] for r in counts.collect()}
    assert (known.tokens, known.types) == (sum(words.values()), len(words))
    share = np.exp(network.log_p(np.repeat(state, 21, 0), np.arange(21)))
    total = share[14 + np.arange(7)] @ (1 / known.smoothed_rest)
    for w, n in words.items():
        sign = int(known.signs([bytes(w)], known.places([bytes(w)]))[0])
        total += share[sign] * (1 if sign < 14 else (n + 1) / known.smoothed_rest[sign - 14])
    assert total == pytest.approx(1)
    documents = [rng.integers(0, 21, n).astype(np.int32) for n in (1, 5, 700, 33)]
    together = network.score(documents)
    apart = [lm.Network(np.arange(30, 9, -1), lm.Settings(head=14, groups=7, class_words=6, embedding=3, hidden=4, score_window=1, score_lanes=1), network.weights).score([d])[0] for d in documents]
    assert together == pytest.approx(apart, rel=1e-4)
    ids, keep = rng.integers(0, 21, (7, 3)), np.ones((7, 3))
    keep[0] = keep[3, 1] = 0
    valid = np.ones((7, 3), bool)
    _, grad = network.gradient(ids, keep, valid, np.zeros((4, 3)))
    for name, w in network.weights.items():
        at = tuple(rng.integers(0, d) for d in w.shape)
        old, slopes = w[at], []
        for step in (1e-4, -1e-4):
            w[at] = old + step
            slopes.append(network.gradient(ids, keep, valid, np.zeros((4, 3)))[0])
        w[at] = old
        assert grad[name][at] == pytest.approx((slopes[0] - slopes[1]) / 2e-4, abs=2e-3)


def plain_spans(x):
    ok = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(v) <= 255 for v in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(s := re.sub(r"\D", "", m[0])) <= 19 and ok(s)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_plain_identifiers_like_the_patterns():
    rnd = random.Random(1)
    parts = [*"ab.@-+ ()0123456789%_\n", "1.2.3.4", "@x.y", " 4111 1111 1111 1111", "+1 (222) 333-4444", "300.1.1.1"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 40)))
        assert pii.find(text) == plain_spans(text)
    assert pii.find("a" * 300_000 + "1" * 300_000 + "+" * 300_000) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail bob [at] example [dot] com now", [("email", "bob [at] example [dot] com")]),
        ("write to bob at example dot com please", [("email", "bob at example dot com")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("plus one two zero two five five five zero one four seven", [("phone", "plus one two zero two five five five zero one four seven")]),
        ("b​ob@exa​mple.com", [("email", "b​ob@exa​mple.com")]),
        ("４１１１１１１１１１１１１１１１", [("card", "４１１１１１１１１１１１１１１１")]),
        ("ip 10 dot 2 dot 3 dot 4", [("ip", "10 dot 2 dot 3 dot 4")]),
        ("look at the dot here, at home", []),
        ("john.smith at example.com", [("email", "john.smith at example.com")]),
        ("email: john at mail.example.org", [("email", "john at mail.example.org")]),
        ("Look at example.com, or write to ann at example.net", [("email", "ann at example.net")]),
        ("available at example.com", []),
        ("one two three at the end", []),
        ("ask bob AT mail DOT xyz now", [("email", "bob AT mail DOT xyz")]),
        ("contact bob at mail dot tech", [("email", "bob at mail dot tech")]),
        ("bob @ mail.xyz", [("email", "bob @ mail.xyz")]),
        ("host one two seven dot zero dot zero dot one", [("ip", "one two seven dot zero dot zero dot one")]),
        ("one dot two dot three dot four.", [("ip", "one dot two dot three dot four")]),
        ("jane.doe at example.io", [("email", "jane.doe at example.io")]),
        ("email me: john at example.com", [("email", "john at example.com")]),
        ("E-mail: ann at example.museum.org", [("email", "ann at example.museum.org")]),
        ("mail to j o h n @ example.com", [("email", "j o h n @ example.com")]),
        ("3 apples @ 4.50 each, see you @ noon.Then we go", []),
        ("she stared at the dot above and at a dot below", []),
        ("we met at noon.then he left at six.thirty", []),
        ("one dot two", []),
    ],
)
def test_disguises(text, want):
    base = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in pii.find_disguised(text, base)] == want


def test_pii_rows(spark, awkward):
    rows = {r["doc_id"]: r for r in pii.scan(awkward).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    for i, r in rows.items():
        assert r["base_sha256"] == hashlib.sha256(pii.spell(plain_spans(texts[i])).encode()).hexdigest()
    assert [rows[13][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(awkward).collect()}
    assert clean[13] == "mail <EMAIL>, <PHONE> or <CARD> at <IP>" and clean[0] is None and clean[5] == texts[5]
    assert pii.scan(empty(spark, awkward)).count() == 0


def test_licenses(spark, awkward):
    grant, notice = licenses.SENTENCES["MIT-GRANT"][0], licenses.SENTENCES["MIT-NOTICE"][0]
    rows = [
        (1, f"Title\n{grant.upper()}:\nThe Above {notice[10:]}."), (2, f"{notice}. {grant}."), (3, "Licensed under the Apache License, Version 2.0."),
        (4, None), (5, ""), (6, "MIT License\nMIT License\n" * 500), (None, "MIT License"), (7, "Released under the MIT License. Other words. All rights reserved."), (8, f"{notice}. {grant}. {notice}."),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, place int, words string, sentence_id string")
    got = {r["doc_id"]: (r["n_sentences"], r["sentence_ids"], r["rules"], r["licenses"]) for r in licenses.scan(docs).collect()}
    assert got == {
        1: (2, "MIT-GRANT,MIT-NOTICE", "mit-text", "MIT"), 2: (2, "MIT-NOTICE,MIT-GRANT", "", ""), None: (1, "MIT-NAME", "mit-name", "MIT"),
        3: (1, "APACHE2-NAME", "apache-2.0-name", "Apache-2.0"), 6: (1000, "MIT-NAME", "mit-name", "MIT"),
        7: (2, "MIT-NAME,RESERVED", "all-rights-reserved,mit-name", "MIT,Proprietary"), 8: (3, "MIT-NOTICE,MIT-GRANT,MIT-NOTICE", "mit-text", "MIT"),
    }
    assert licenses.scan(empty(spark, awkward)).count() == 0
    assert licenses.scan(docs.union(docs.where("doc_id = 3"))).where("doc_id = 3").count() == 2


LICENSE_TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "gpl-3.0-header": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
""",
    "mit-spdx": "// SPDX-License-Identifier: MIT\nint x;",
    "apache-2.0-spdx": "# SPDX-License-Identifier: Apache-2.0\r\nimport x",
    "gpl-3.0-spdx": "/* SPDX-License-Identifier: GPL-3.0-only */",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "gpl-2.0-header": """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
""",
    "lgpl-2.1-header": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
""",
    "mpl-2.0-header": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
    "gpl-3.0-text": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
""",
    "apache-2.0-text": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.
""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
""",
    "cc-by-4.0-name": "Words.\nThis work is licensed\nunder CC-BY 4.0",
}


def test_licenses_as_they_are_written(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSE_TEXTS.values())], "doc_id long, text string")
    got = {r["doc_id"]: r["rules"] for r in licenses.scan(docs).collect()}
    assert got == dict(enumerate(LICENSE_TEXTS))
    assert all(re.search(licenses._CUE, words) for some in licenses.SENTENCES.values() for words in some)
    apart = spark.createDataFrame([(1, "Licensed under the.\nGNU General Public License. Version 3"), (2, "the MIT\n\nlicense")], "doc_id long, text string")
    assert licenses.scan(apart).count() == 0


@pytest.mark.parametrize(
    ("text", "spans", "clean"),
    [
        ("jоhn@example.com", "email:0:16,email:2:16", "<EMAIL>"),
        ("at a@b.cоm.", "email:3:8,email:3:10", "at <EMAIL>."),
        ("bob [at] mail [dot] online", "email:0:26", "<EMAIL>"),
        ("bоb@mail.example", "email:0:16,email:2:16", "<EMAIL>"),
        ("bob@example . com", "email:0:17", "<EMAIL>"),
        ("call (plus one two zero two five five five zero one four seven)", "phone:6:62", "call (<PHONE>)"),
        ("jоhn@example.com and 10.0.0.1", "email:0:16,email:2:16,ip:21:29", "<EMAIL> and <IP>"),
    ],
)
def test_whole_disguises(text, spans, clean):
    base = pii.find(text)
    every = base + pii.find_disguised(text, base)
    assert sorted(pii.spell(every).split(",")) == sorted(spans.split(",")) and pii.redact(text, every) == clean


def test_quick_searches_miss_no_disguise():
    rnd = random.Random(3)
    parts = [
        *"ab1@.,-()[]{}<> \t\n", " ", "  ", "at", "AT", "dot", "Dot", "one", "Two", "seven", "ſix", "nıne", "plus", "com", "org", "о", "Υ", "\u200b", "\u00a0", "é", "K",
    ]
    hits = 0
    for _ in range(60_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 12)))
        if pii._TOKEN.search(text):
            hits += 1
            assert pii.cued(text), text
    assert hits > 5000
