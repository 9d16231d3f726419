"""Operators that learn, pack or sign: held-out accuracy, round trips, defined edge cases."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

import corpus_pipeline
from storyloom.llm import decontamination, fingerprints, jaccard, lines, packing, quality, toxicity
from storyloom.llm.common import bounded_sample, unused
from storyloom.llm.plans import QUERIES
from storyloom.llm.tokens import WORD_END, Tokens
from storyloom.session import checkpoint_folder
from tests.llm.conftest import prose

SF, VOCABULARY = "/root/testdata/sf0.01", public_tokenizers.path("word_bpe_49k.json")


def accuracy(spark, rows, label, parts, rest):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % parts == rest]
    assert held and all(r.held_out for r in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    return sum(r.predicted == labels[r.doc_id] for r in held) / len(held)


def test_quality_on_the_held_out_fold(spark):
    assert accuracy(spark, QUERIES["op2_quality"](spark, SF).collect(), "quality", 4, 2) >= 0.9


def test_toxicity_on_the_held_out_fold(spark):
    assert accuracy(spark, QUERIES["op6_toxicity"](spark, SF).collect(), "toxic", 3, 1) >= 0.9


def test_scores_without_labels_and_texts(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, None, 2), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for labels in (none, odd):
            assert all(0 <= r.score <= 1 for r in module.rated(docs, labels).collect())
        assert module.rated(no_docs, none).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns


def test_scores_keep_the_label_shares_above_the_sample_bound(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(400)], "doc_id long, text string")
    for module, share in ((quality, 0.9), (toxicity, 0.1)):
        labels = spark.createDataFrame([(i, int(i % 10 < share * 10)) for i in range(400)], "doc_id long, label int")
        for bound in (400, 40):
            scores = module.fit(docs, labels, max_rows=bound).score([r.text for r in docs.collect()])
            assert abs(scores.mean() - share) < 0.07


def test_a_too_long_text_is_passed_over_alone(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i == 0 else 10)) for i in range(40)], "doc_id long, text string")
    for first in range(0, 40, 8):
        moved = docs.withColumn("doc_id", (F.col("doc_id") + first) % 40)
        labels = docs.selectExpr("doc_id", "1 AS label")
        assert len(bounded_sample(moved, labels, 40, 1000)) == 39


def test_clauses():
    grammar = toxicity.Grammar({"moro": 4.0})
    kinds = lambda text: [name for name, _ in grammar.clauses(text)]
    assert kinds("You are an idiot. Fine day.") == ["insult_at_target"]
    assert kinds("that was not stupid") == ["negated"] and kinds('Ann said "morons"') == ["reported"]
    assert kinds("a fine day; nothing else") == [] and kinds("") == [] and kinds("some worthless talk") == ["insult"]


def test_tokens_equal_the_library():
    codec, own = Tokenizer.from_file(VOCABULARY), Tokens(VOCABULARY)
    rng = random.Random(3)
    texts = ["", " ", "It's 'tis 12,3 ÀÉ×÷ß “a” x's\n\n¿qué? #$%&'s", "ΑΣ İ \x85 \x1c á", *(prose(rng, 50) for _ in range(20))]
    for text in [*texts, *texts]:
        assert own(text).tolist() == codec.encode(text, add_special_tokens=False).ids


def test_new_words_are_encoded_together(monkeypatch):
    codec, own = Tokenizer.from_file(VOCABULARY), Tokens(VOCABULARY)
    assert all(letter + WORD_END in codec.get_vocab() for letter in ByteLevel.alphabet())  # every word has a piece that ends it
    texts = [prose(random.Random(k), 40) + f" zyx{k}qé 's ${k}&" for k in range(30)]
    want = [codec.encode(text, add_special_tokens=False).ids for text in texts]
    monkeypatch.setattr(own, "codec", None)  # the whole codec, slow on single words, is for other texts
    assert [ids.tolist() for ids in own.many(texts)] == want == [ids.tolist() for ids in own.many(texts)]


def test_packing_round_trip(docs, no_docs):
    codec = Tokenizer.from_file(VOCABULARY)
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append(np.array([*codec.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    rows = packing.pack(docs, VOCABULARY).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for key, all_ids in want.items():
        assert sum(p.length for p in pieces[key]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for p in sorted(pieces[key], key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(all_ids[0]), zlib.crc32(all_ids[0][at:at + p.length].tobytes()))
                at += p.length
    total = padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        total, padding = total + at, padding + (4096 - at if at & (at - 1) else 0)
    assert padding <= 0.02 * total
    assert packing.pack(no_docs, VOCABULARY).count() == 0


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(1)
    demand = np.zeros(65, np.int64)
    np.add.at(demand, rng.integers(1, 65, 20_000), 1)
    plan = packing.patterns(demand, 64)
    used = sum(times * counts for times, counts in plan)
    assert (used <= demand).all() and all((np.arange(65) * counts).sum() <= 64 for _, counts in plan)
    assert (demand - used).sum() < 65 * 8 and sum(times for times, _ in plan) <= (demand * np.arange(65)).sum() / 64 * 1.02


def test_templates(spark):
    item = "Tom has 3 apples and 5 pears on the table and he gives 3 to Anna today"
    rows = [(1, item), (2, "well Bob has 7 apples and 9 pears on the table and he gives 7 to Sue today"), (3, "well Bob has 7 apples and 9 pears on the table and he gives 8 to Sue today"),
            (4, None), (5, ""), (None, item), (1, item), (6, item.upper()), (7, "some apples and pears on the table")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "on the")], "item_id long, text string")
    found = {r.doc_id: r.item_ids for r in decontamination.report(docs, benchmark).collect()}
    assert {k for k, v in found.items() if 9 in v} == {1, 2, 6, None} or {k for k, v in found.items() if 9 in v} == {1, 2, None}
    assert 3 not in {k for k, v in found.items() if 9 in v} and 4 not in found and 5 not in found
    assert decontamination.report(docs.limit(0), benchmark).count() == 0 and decontamination.report(docs, benchmark.limit(0)).count() == 0


def contaminated(spark, texts, *items):
    """The numbers of the texts that an item contaminates."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id for r in decontamination.report(docs, benchmark).collect()}


def test_short_items_and_dense_placeholders(spark):
    around = "some words before it stand here and {} then more of them follow after it"
    short, dense = "What is the capital of France?", "What is 12 + 15 + 31 + 44 + 5 + 6 + 7?"
    assert contaminated(spark, [around.format(short), short, around.format("What is the size of France?"), "What is the"], short) == {0, 1}
    assert contaminated(spark, [around.format(dense), around.format("What is 13 + 25 + 41 + 54 + 8 + 9 + 1?")], dense) == {0}
    assert contaminated(spark, [around.format("at 7 Paris"), around.format("at 8 Rome")], "7 Paris") == {0}
    # A dense stretch inside or at the end of a longer item with other numbers.
    long = "please write the numbers {} {} {} {} {} {} {} {} {} in one line below"
    assert contaminated(spark, [around.format(long.format(*range(30, 39))), around.format(long.format(*[5] * 9))], long.format(*range(9))) == {0, 1}
    assert contaminated(spark, [around.format("add up all of these numbers for me 4 5 6 7 8 9 10 11")], "add up all of these numbers for me 3 2 5 7 9 12 1 0") == {0}


def test_names_of_any_place_and_case(spark):
    item = "Tom has 3 apples. Tom buys 4 more pears. How many fruits does Tom have now?"
    other = item.replace("Tom", "Bob").replace("3", "5")
    two = other.replace("Bob buys", "Sue buys")
    assert contaminated(spark, [item, other, two, f"Question 5 {other}", item.lower(), item.upper(), item.replace(" ", " \n")], item) == {0, 1, 3, 4, 5, 6}
    named = "The train that Anna took from Berlin to Hamburg with Peter left late"
    assert contaminated(spark, [named.lower(), named.upper(), f"Here: {named.lower()} again", named.replace("Anna", "Mary"), named.replace("late", "early")], named) == {0, 1, 2, 3, 4}
    assert contaminated(spark, ["Will has 3 apples. Will buys 4 more pears. How many fruits does Will have now?"], item) == {0}


def test_planted_passages_are_found(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " ".join(t.lower().split())
    passages = [flat(r.text) for r in items.collect()]
    planted = {r.doc_id for r in docs.collect() if any(p in flat(r.text) for p in passages)}
    assert {r.doc_id for r in decontamination.report(docs, items).collect()} == planted
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(planted)


CLASHING = ["score", "quality", "quality_", "_text", "_own", "_id", "_key", "_gone", "gone_id", "GONE_KEY", "gone_lines", "found_id", "found_key_", "key_id"]


def test_names_no_column_has():
    assert unused(["A", "a_"], "a") == "a__" and unused([], "a") == "a"


def test_filters_leave_the_values_of_clashing_columns(spark):
    """Every filter returns the rows it keeps as they came, whatever their other columns are called."""
    rng = random.Random(4)
    near = prose(rng, 40)
    item = prose(rng, 20)
    texts = [near, near + " end", prose(rng, 40), f"{prose(rng, 9)} {item} {prose(rng, 9)}", None, "", prose(rng, 12)]
    rows = [(i, t, *(f"{c}-{i}" for c in CLASHING)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    without = lambda gone: [r for r in rows if r[0] not in gone]
    for kept, want in ((jaccard.keep_one(frame), without({1})), (decontamination.clean(frame, items), without({3})),
                       (lines.dedup(frame), without({1})), (quality.keep_good(frame, labels), rows)):
        assert kept.columns == frame.columns
        assert sorted(tuple(r) for r in kept.collect()) == want


def test_fingerprints(spark, docs, no_docs):
    rows = fingerprints.report(docs).collect()
    keyed = sorted({(r.doc_id is not None, r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()})
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    for k, (_, key, text) in enumerate(keyed):
        follow, n = keyed[(k + 1) % len(keyed)][2], len(text)
        edited = text[:n - n // 4] + follow[:n // 4]
        assert (by_id[key].n_chars, by_id[key].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
    assert by_id[107].fingerprint == by_id[108].fingerprint and by_id[101].fingerprint == ""
    # Texts whose next one is neither a copy nor a near copy of them.
    long = [r for r in rows if r.n_chars > 150 and r.doc_id is not None and r.doc_id < 60 and r.doc_id % 6 in (3, 4)]
    assert long
    assert sum(r.near_edited for r in long) > 3 * sum(r.near_next for r in long) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.report(no_docs).count() == 0


def test_pipeline_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == names
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    count = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows.where("start = 0").collect())
    assert count(corpus_pipeline.run(spark, sf)) == count(last)


def test_pipeline_deletes_what_the_next_stage_has_read(spark, monkeypatch):
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))  # other runs may have left tables there
    held = lambda: {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    seen = []
    stage = lambda spark, docs, sf: (seen.append(held()), docs.where(f"doc_id > {len(seen)}"))[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"try_{k}", stage) for k in range(4)])
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").where("doc_id > 4").count() > 0
    assert seen == [set(), {"stage-try_0"}, {"stage-try_1"}, {"stage-try_2"}]


def test_pipeline_moves_few_texts_at_a_time(spark):
    name, sf = "spark.sql.execution.arrow.maxRecordsPerBatch", "/root/testdata/sf0.001"
    before = spark.conf.get(name, None)

    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [max(b.num_rows for b in batches)]})

    docs = spark.range(2500).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    try:
        for stage in (corpus_pipeline.classify_quality, corpus_pipeline.decontaminate, corpus_pipeline.pack):
            spark.conf.set(name, "10000")
            stage(spark, docs, sf)
            assert docs.coalesce(1).mapInArrow(sizes, "n long").first().n <= 1000
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
