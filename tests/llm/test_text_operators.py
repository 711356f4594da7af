"""Text operators against plain versions, on the small tables and on awkward rows."""

import hashlib
import os
import sys

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from creaseline.llm import codec, decontaminate, id_store, lines, near_copies, passages, pii, quality, token_counts, toxicity  # noqa: E402
from creaseline.llm.common import components, shared_path  # noqa: E402
from creaseline.llm.queries import QUERIES  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SENTENCE = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. "
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Don't  STOPé ́ 42 <|endoftext|> x y\x1cz"), (6, SENTENCE * 40),
    (7, SENTENCE * 40), (7, SENTENCE * 40), (8, "a" * 3000 + " " + "1 2 3 " * 3000), (9, "Mail a@b.co.uk, c_d@e.f or +1 (988) 555-2485; 10.0.0.256 10.0.0.255"),
    (10, "card 4111 1111 1111 1111 or 4111-1111-1111-1112, a@b.c_d@e.f"), (None, SENTENCE * 40), (11, SENTENCE + "\n\n" + SENTENCE),
]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    own = [(i, t, "en", 5, True) for i, t in AWKWARD]
    return spark.createDataFrame(own, "doc_id long, text string, lang string, n_tokens long, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_quality_base_counts(spark, sf_dir, rows):
    texts = dict(rows)
    for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect():
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert own == brute.base_rules(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_quality_awkward_rows(spark, awkward, empty):
    out = quality.quality_verdicts(awkward, labels_of(spark, [(1, None, None), (None, 1, 0), (99, 1, 0)])).collect()
    assert sorted((r["doc_id"] or 0, r["base_failed"]) for r in out) == sorted((i or 0, brute.base_rules(t)[-1]) for i, t in AWKWARD)
    assert quality.quality_verdicts(empty, labels_of(spark)).count() == 0


def test_exact_binomial_bound():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-6)
    assert quality.upper_bound(10, 10, 0.05) == 1.0
    assert quality.upper_bound(3, 50, 0.05) == pytest.approx(0.1478, abs=2e-3)


def test_certified_cutoffs_hold_the_risk(spark):
    rng = np.random.default_rng(0)
    good = [(1, "en", *([0.0] * 5)) for _ in range(3000)]
    bad = [(0, "en", float(rng.uniform(0.8, 1)), 0.0, 0.0, 0.0, 0.0) for _ in range(300)]
    table = spark.createDataFrame(good + bad, "quality int, lang string, " + ", ".join(f"{r} double" for r in quality.RULES))
    chosen = quality.certified_cutoffs(table).collect()
    assert [(r["rule"], r["lost"], r["caught"]) for r in chosen] == [("symbol_share", 0, 300)]
    assert chosen[0]["bound"] <= quality.RISK / len(quality.RULES)
    assert quality.certified_cutoffs(table.limit(20)).count() == 0  # too few labels prove nothing


def test_token_counts_and_cache(spark, awkward, empty):
    cache = shared_path(spark, "cache")
    library = brute.library("word_bpe_49k.json")
    expected = sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in AWKWARD)
    for _ in range(2):
        out = token_counts.token_counts(awkward, WORD, cache, limit=100).collect()
        assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_bytes"]) for r in out) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in out)
        stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(f"{cache}/tokenizer={token_counts.tokenizer_digest(WORD)[:16]}")
        assert stored.count() == len({" ".join(brute.words_of(t)) for _, t in AWKWARD})  # the second run appends nothing
    assert token_counts.token_counts(empty, WORD).count() == 0


def test_round_trip_digests(spark, sf_dir, rows, awkward):
    library = brute.library("word_bpe_49k.json")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op6_bpe_round_trip"](spark, sf_dir).collect()}
    assert got == {i: brute.round_trip(library, t) for i, t in rows}
    own = sorted((r["doc_id"] or 0, r["ids_sha256"]) for r in codec.round_trip_digests(awkward, WORD).collect())
    assert own == sorted((i or 0, brute.round_trip(library, t)[1]) for i, t in AWKWARD)


def test_encode_then_decode(awkward, empty):
    library = brute.library("word_bpe_49k.json")
    encoded = codec.encode_texts(awkward, WORD, keep_text=True)
    for r in codec.decode_ids(encoded, WORD).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert codec.encode_texts(empty, WORD).count() == 0


def test_id_store(spark, sf_dir, rows, awkward, empty):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op7_id_store"](spark, sf_dir).collect()}
    library = brute.library("byte_bpe_50k.json")
    assert got == brute.stored(library, rows)
    path = shared_path(spark, "ids")
    id_store.write_ids(awkward, BYTE, path, shard_tokens=500)
    assert id_store.stored_documents(awkward, path).count() == len(AWKWARD)
    asked = spark.createDataFrame([(5,), (8,), (12345,)], "doc_id long")
    read = {r["doc_id"]: r["token_ids"] for r in id_store.read_documents(asked, path).collect()}
    assert read == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in AWKWARD if i in (5, 8)}
    nothing = shared_path(spark, "none")
    id_store.write_ids(empty, BYTE, nothing)
    assert id_store.stored_documents(empty, nothing).count() == 0


def test_perfect_hash_is_minimal():
    hashes = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)
    sizes, bits, left = id_store.build_hash(hashes)
    assert not len(left)
    assert sorted(id_store.slots_of(hashes, sizes, bits)) == list(range(20_000))


def test_near_copies(spark, sf_dir, rows, awkward, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_near_copies"](spark, sf_dir).collect()}
    assert got == brute.near_classes(rows, 2)
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_copies.document_classes(awkward, 2).collect()}
    assert (7, 6, False) in out and (None, None, True) in out and (1, 1, True) in out
    assert near_copies.document_classes(empty).count() == 0


def test_near_copies_large_group(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(150)]
    out = near_copies.document_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {0}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_line_dedup(spark, sf_dir, rows, awkward, empty):
    out = QUERIES["op5_line_dedup"](spark, sf_dir).collect()
    assert {(r["doc_id"], int(n)) for r in out for n in r["removed_lines"].split(",") if n} == brute.removed_lines(rows)
    texts = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(awkward).collect()}
    assert texts[7] == "" and texts[6] == SENTENCE * 40 and texts[1] is None and texts[None] == SENTENCE * 40
    assert texts[11] == ""  # 16 of the 20 shingles of the line of documents 6 and 7; the blank line stays
    assert lines.without_repeated_lines(awkward).columns == awkward.columns
    assert lines.without_repeated_lines(empty).count() == 0


def test_line_tokens_do_not_depend_on_place():
    line = "Één twee\tdrie vier  vijf zes 七 acht"
    texts = [line, None, "", "kort\n" + line + "\n\n" + line.replace("\t", " "), "een twee drie", "a b c d e f g h"]
    owner, number, chars, of, tokens = lines.line_tokens(texts, 5)
    sets = [tokens[of == i].tolist() for i in range(len(owner))]
    assert owner.tolist() == [0, 3, 3, 4, 5] and number.tolist() == [0, 1, 3, 0, 0]
    assert chars.tolist() == [len(line)] * 3 + [13, 15]
    assert sets[0] == sets[1] == sets[2] and [len(set(s)) for s in sets] == [4, 4, 4, 1, 4]
    assert len(set(sets[0]) | set(sets[3]) | set(sets[4])) == 9
    assert all(len(x) == 0 for x in lines.line_tokens([None, ""], 5))


def test_decontamination(spark, sf_dir, rows, awkward, empty):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in QUERIES["op3_decontamination"](spark, sf_dir).collect()}
    assert got == brute.overlaps(rows, items, decontaminate.MASKS)
    bench = spark.createDataFrame([(1, SENTENCE), (2, None), (3, "two words"), (None, SENTENCE)], "item_id long, text string")
    one = decontaminate.contaminated(awkward, bench)
    assert {r["doc_id"] for r in one.collect()} == {6, 7, 11}
    assert {r["doc_id"] for r in decontaminate.contaminated(awkward, bench, broadcast_seeds=0).collect()} == {6, 7, 11}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean_documents(awkward, bench.limit(0)).count() == len(AWKWARD)


def test_decontamination_tolerates_substitutions(spark):
    words = SENTENCE.split()
    changed = [w if i % 7 else "other" for i, w in enumerate(words, 3)]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(words[:8]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, SENTENCE)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()] == [1]


def test_toxicity_learns_words_from_document_labels(spark, sf_dir, awkward, empty):
    toxic = [(i, f"Fine words here number{i}. You are a dolt today. More fine words.") for i in range(60)]
    clean = [(i, f"Fine words here number{i}. You are a friend today. More fine words.") for i in range(60, 200)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    model = toxicity.train(docs, labels_of(spark, [(i, 1, int(i < 60)) for i in range(0, 200, 2)] + [(None, 1, 1), (1, 1, None)]))
    out = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model, spans=True).collect()}
    assert all((out[i]["predicted"] == 1) == (i < 60) for i in out)
    assert [dict(toxic)[3][s["start"] : s["end"]].strip() for s in out[3]["toxic_spans"]] == ["You are a dolt today."]
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(awkward, model).collect()}
    assert scores[1] == scores[2] == 0.0 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.toxicity_scores(empty, toxicity.train(empty, labels_of(spark))).count() == 0


def test_repeated_passages(spark, sf_dir, rows, awkward, empty):
    windows = {}
    for doc_id, text in rows:
        words = brute.words_of(text)
        for k in range(len(words) - 49):
            windows.setdefault(tuple(words[k : k + 50]), set()).add(doc_id)
    repeating = {i for s in windows.values() if len(s) > 1 for i in s}
    found = {r["doc_id"] for r in QUERIES["op9_repeated_passages"](spark, sf_dir).collect()}
    assert repeating <= found
    out = passages.repeated_passages(awkward).collect()
    assert {r["doc_id"] for r in out} == {6, 7, 8, 11} or {r["doc_id"] for r in out} == {6, 7, 11}
    assert passages.repeated_passages(empty).count() == 0


def test_personal_data(spark, sf_dir, rows, awkward, empty):
    def digest(text):
        return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(text)).encode()).hexdigest()

    got = {r["doc_id"]: r["base_sha256"] for r in QUERIES["op10_personal_data"](spark, sf_dir).collect()}
    assert got == {i: digest(t) for i, t in rows}
    own = sorted((r["doc_id"] or 0, r["base_sha256"]) for r in pii.span_report(awkward).collect())
    assert own == sorted((i or 0, digest(t)) for i, t in AWKWARD)
    assert pii.span_report(empty).count() == 0


def test_personal_data_learns_contexts(spark):
    known = [(i, f"then hotline +1 (988) 555-2{i:03d} answers") for i in range(12)]
    docs = spark.createDataFrame([*known, (50, "then hotline 555-0100-77 answers"), (51, "it took 555-0100-78 steps")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.span_report(docs).collect()}
    assert out[50]["spans"] == "phone:13:24" and out[50]["n_phone"] == 0
    assert out[51]["spans"] == ""


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir).collect()
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").rdd.map(tuple).collect())
    library = brute.library("word_bpe_49k.json")
    kept = {i: t for i, t in texts.items() if not brute.base_rules(t)[-1]}
    gone = brute.removed_lines(kept.items())
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in kept.items()}
    classes = brute.near_classes(left.items(), 5)
    left = {i: t for i, t in left.items() if classes[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute.overlaps(left.items(), items, decontaminate.MASKS)}
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items() if i not in bad}
    assert {r["doc_id"]: r["token_ids"] for r in out} == expected
