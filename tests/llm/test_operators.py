"""Each operator against a brute-force version, exact round trips and edge cases."""

import gc
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from newsflow.llm import (bpe, chat, components, graph_ann, lang_id, line_crf, near_dedup, packing,
                          queries, repetition, suffix_dedup, urls)
from newsflow.llm.common import blocks, held_out, word_codes

SF = "/root/testdata/sf0.001"
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- quality rules

def brute_repeats(text):
    w = words(text)
    longest, covered = 0, [False] * len(w)
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            n = 0
            while i != j and i + n < len(w) and j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            best = max(best, n)
        longest = max(longest, best)
        if best >= repetition.MIN_REPEAT_WORDS:
            covered[i:i + best] = [True] * best
    three = Counter(zip(w, w[1:], w[2:]))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if three[tuple(w[i:i + 3])] > 1:
            again[i:i + 3] = [True] * 3
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), sum(again), sum(covered), longest)


def test_repetition_matches_brute_force():
    rng = np.random.default_rng(1)
    texts = ["", " ", "a", "a a a a a a a a a a a a a a a a a a", "x\nx\n\ny x\nx #*|"]
    texts += [" ".join(rng.choice(list("abc\n"), rng.integers(1, 90))) for _ in range(60)]
    found = [repetition.measure_block(b) for b in blocks(texts, limit=200)]
    for name, column in zip(repetition.MEASURES, zip(*map(brute_repeats, texts))):
        assert np.concatenate([f[name] for f in found]).tolist() == list(column), name


# -- BPE and packing

def test_bpe_equals_the_library(edge_docs):
    library = Tokenizer.from_file(WORD_BPE)
    rows = edge_docs.select("text", bpe.bpe_digest(F.col("text"), WORD_BPE).alias("e"),
                            bpe.bpe_ids(F.col("text"), WORD_BPE).alias("ids")) \
        .withColumn("back", bpe.bpe_decode(F.col("ids"), WORD_BPE)).collect()
    for row in rows:
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert row["ids"] == want and row["back"] == decoded
        assert (row["e"]["n_tokens"], row["e"]["ids_sha256"], row["e"]["decoded_sha256"]) == (
            len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def test_every_token_pair_test_is_needed():
    vocabulary = bpe.encodings(WORD_BPE).vocabulary
    assert vocabulary.encode(vocabulary.word("aaaaa")) == \
        Tokenizer.from_file(WORD_BPE).encode("aaaaa", add_special_tokens=False).ids


def check_pieces(rows, texts):
    library = Tokenizer.from_file(BYTE_BPE)
    for doc, pieces in rows.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == np.cumsum(
            [0] + [r["length"] for r in pieces])[:-1].tolist()
        assert all(r["length"] == 2048 for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == r["ids_crc32"] and len(part) == 4 * r["length"]


def test_packing(spark):
    docs = docs_of(spark)
    rows = packing.packed_pieces(docs, BYTE_BPE).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    check_pieces(by_doc, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert len(by_doc) == docs.count()
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        lengths = [r["length"] for r in own]
        assert [r["offset"] for r in own] == np.cumsum([0] + lengths)[:-1].tolist()
        assert sum(lengths) <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(by_sequence) <= least + 2


@pytest.mark.parametrize("text", [
    "a" + " " * 2_000_000 + "b c", "w x" + "\n" * 1_100_000 + " y z", "e f" + " \n" * 4000 + "z",
    "a" + " " * 5000 + "\n" + "b <|endoftext|>" + "\t" * 6000, "q" + "\xa0" * 5000 + "z  z",
    "a" * 1_000_000, " " * 5000, "x" + "\x1c" * 5000 + "y"], ids=range(8))
def test_ids_of_long_runs(text):
    assert packing.Runs(BYTE_BPE).encode(text) == np.array(
        Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER_BYTES", 20_000)
    monkeypatch.setattr(bpe, "REMEMBER_BYTES", 20_000)
    runs, words_ = packing.Runs(BYTE_BPE), bpe.Words(bpe.Vocabulary(WORD_BPE))
    library = [Tokenizer.from_file(p) for p in (BYTE_BPE, WORD_BPE)]
    for i in range(60):
        text = " ".join(chr(0x4E00 + i * 40 + j) * 30 + f"x{j}" for j in range(40))
        assert runs.encode(text) == np.array(library[0].encode(text).ids, "<u4").tobytes()
        ids = " ".join(p[1] for p in bpe.encode_text(text, words_))
        assert ids == " ".join(map(str, library[1].encode(text, add_special_tokens=False).ids))
        assert len(runs) < 200 and len(words_) < 200 and len(words_.words) < 200


def test_plan_packs_two_where_greedy_packs_one():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]
    assert sum(t for t, _ in packing.plan({5: 7, 1: 3}, 10)) == 4
    assert packing.plan({}, 10) == []


def test_packing_edges(edge_docs, no_docs):
    rows = packing.packed_pieces(edge_docs, BYTE_BPE).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.packed_pieces(no_docs, BYTE_BPE).count() == 0


# -- deduplication

def brute_removed(rows, length=50):
    seen, out = {}, {}
    for doc in sorted({d for d, _ in rows}):
        for raw in [t for d, t in rows if d == doc]:
            gone = bytearray(len(raw))
            for i in range(len(raw) - length + 1):
                if seen.setdefault(raw[i:i + length], doc) < doc:
                    gone[i:i + length] = b"\1" * length
            kept = bytes(b for b, g in zip(raw, gone) if not g)
            spans = len(re.findall(rb"\x01+", bytes(gone)))
            out.setdefault(doc, []).append(
                (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {doc: sorted(v) for doc, v in out.items()}


@pytest.mark.parametrize("run_bytes", [1 << 30, 40000])
def test_suffix_dedup_matches_brute_force(spark, edge_docs, run_bytes):
    docs = docs_of(spark).unionByName(edge_docs.filter("doc_id is not null").withColumn(
        "doc_id", F.col("doc_id") + 1000).select(*docs_of(spark).columns))
    got = {}
    for r in suffix_dedup.cut_repeats(docs, run_bytes=run_bytes).collect():
        got.setdefault(r["row"]["doc_id"], []).append(
            (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert {d: sorted(v) for d, v in got.items()} == brute_removed(rows)


def test_suffix_dedup_edges(edge_docs, no_docs):
    rows = suffix_dedup.cut_repeats(edge_docs, kept_text=True).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["n_removed"] == 0 for r in rows if r["row"]["doc_id"] == 9)
    late = [r for r in rows if r["row"]["doc_id"] is None]
    assert late[0]["text"] == "no id here, just a few words"
    assert suffix_dedup.cut_repeats(no_docs).count() == 0


def test_loser_tree_merges_and_counts_common_bytes():
    rng = np.random.default_rng(3)
    width = suffix_dedup.WIDTH
    runs, all_ = [], []
    for n in (0, 5, 40, 1, 17):
        keys = sorted({bytes(rng.integers(0, 2, width, np.uint8)) for _ in range(n)})
        matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)
        prefix, rest = suffix_dedup.front_code(matrix) if n else (np.zeros(0, np.uint8), matrix)
        if n:
            assert (suffix_dedup.front_decode(prefix, rest) == matrix).all()
        runs.append((keys, prefix.tolist()))
        all_ += keys
    order, prefixes = suffix_dedup.merge(runs)
    streams = [iter(keys) for keys, _ in runs]
    merged = [next(streams[r]) for r in order]
    assert merged == sorted(all_)
    for a, b, n in zip(merged, merged[1:], prefixes[1:]):
        assert a[:n] == b[:n] and (n == width or a[n] != b[n])


def test_words_of_a_block_are_freed_with_it():
    gc.collect()
    gc.disable()
    try:
        word_codes([b"one two two", b"three"])
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_texts_stay_in_place_where_few_copies_go(spark, edge_docs):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        kept = near_dedup.keep_first(edge_docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert kept.count() < edge_docs.count()
    finally:
        spark.conf.set(name, before)


def test_near_duplicates_edges(edge_docs, no_docs):
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(edge_docs).collect()}
    assert rows[4]["component_id"] == rows[5]["component_id"] == 4
    assert rows[7]["component_id"] == 7  # only A-Z is lowered
    assert rows[9]["component_id"] == rows[8]["component_id"] == 8
    assert [rows[i]["n_shingles"] for i in (1, 2, 3, 8)] == [0, 0, 0, 1]
    assert rows[1]["component_id"] == 1 and rows[None]["component_id"] is None
    kept = near_dedup.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, 10, 11, 12, None}
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_a_chain_of_links_is_found_without_its_ends_being_similar(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[6 * i:6 * i + 300])) for i in range(12)]  # neighbours: J = 0.96
    rows += [(100 + i, " ".join(base[:300 - i])) for i in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {d: set(zip(*[t.split()[k:] for k in range(5)])) for d, t in rows}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == root


def test_blocks_join_what_stars_leave_apart(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_star_links", lambda *_: spark.createDataFrame(
        [], "a long, b long"))
    base = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"{base} x{i}") for i in range(60)], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs).collect()
    assert {r["component_id"] for r in rows} == {0}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 70), (70, 70), (91, 90)],
                                  "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 70: 70, 90: 70, 91: 70}


# -- models

def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    emission, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    doc = np.zeros(4, int)
    ahead, behind = line_crf.forward_backward(emission, trans, line_crf._chains(doc))
    total, good = 0, np.zeros(4)
    for labels in np.ndindex(2, 2, 2, 2):
        score = sum(e for e, y in zip(emission, labels) if y)
        score += sum(trans[a, b] for a, b in zip(labels, labels[1:]))
        total += np.exp(score)
        good += np.exp(score) * np.array(labels)
    assert np.allclose(line_crf._sigmoid(ahead + behind), good / total)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = line_crf.op4_quality_classifier(spark, folder).join(labels, "doc_id").collect()
    test = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_edges(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert line_crf.train(edge_docs, labels) is None
    assert line_crf.keep_good(edge_docs, labels).count() == edge_docs.count()
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, quality int")
    kept = line_crf.keep_good(edge_docs, both)
    assert kept.columns == edge_docs.columns and kept.count() <= edge_docs.count()
    assert line_crf.keep_good(no_docs, both).count() == 0


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = [r for r in lang_id.op8_language_id(spark, folder).join(lang, "doc_id").collect()
            if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95


def test_language_edges(spark, edge_docs, no_docs):
    model = lang_id.train(docs_of(spark))
    rows = {r["doc_id"]: r["l"] for r in edge_docs.select(
        "doc_id", lang_id.language(F.col("text"), model).alias("l")).collect()}
    assert [rows[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3
    assert rows[8]["lang"] in model[0] and 0 <= rows[8]["score"] <= 1
    assert lang_id.train(no_docs) is None


def test_languages_of_one_document_and_more_than_64(spark):
    # each language has letters of its own
    docs = spark.range(400).filter(~held_out(F.col("id"))).limit(70).collect()
    texts = [(row.id, f"l{i:02d}", " ".join([chr(0x4E00 + 3 * i + j) * 3 for j in range(3)]))
             for i, row in enumerate(docs)]
    assert len(texts) == 70
    table = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    model = lang_id.train(table)
    said = table.select("lang", lang_id.language(F.col("text"), model).alias("l"))
    assert [r for r in said.collect() if r.l.lang != r.lang] == []
    other = spark.createDataFrame([("",), ("12 +",), ("привіт",), ("Ωμέγα",)], "text string")
    said = [tuple(r.l) for r in other.select(lang_id.language(F.col("text"), model).alias("l"))
            .collect()]
    assert said == [(lang_id.UNKNOWN, 0.0)] * 2 + [("l00", 0.0)] * 2


def test_filters_hold_every_member():
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(977)
    words_, rate = lang_id.build((np.arange(5000) % 3, keys), 3)
    mask = np.full(5000, ~np.uint64(0))
    for at in lang_id.positions(keys, len(words_)):
        mask &= words_[at]
    assert (mask >> (np.arange(5000) % 3).astype(np.uint64) & np.uint64(1)).all()
    assert (rate < 0.2).all()


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(900, 16))
    vectors[300:600] = vectors[0] + 1e-3 * rng.normal(size=(300, 16))
    vectors[600:700] = vectors[1]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16),
             (904, [1.0, 2.0]), (905, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in graph_ann.nearest(df, df.filter("vec_id % 50 == 0"), shard_size=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        score = unit @ unit[q]
        score[q] = -9
        best = set(np.lexsort((np.arange(900), -score.round(12)))[:5].tolist())
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in own], score[[v for _, v, _ in own]])
        hits += len(best & {v for _, v, _ in own})
    assert hits / (5 * 18) >= 0.9 and 900 not in got
    assert [v for _, v, _ in sorted(got[600])] == [1, 601, 602, 603, 604]
    assert graph_ann.nearest(df.limit(0), df.limit(0)).count() == 0


# -- native operators

def test_chat_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<!|x <|turn|> <<SYS>> <</SYS>>", "", None, "a<", "|b", "\\n\n"]
    rows = [(c, t, role, texts[(c + t) % 7]) for c in range(7) for t, role in
            enumerate(["system", "user", "assistant", "tool<|body|>\n", None, "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(df.withColumn("content", chat.text_part(F.col("text"))))
    for r in done.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), "formatted",
                         chat.loss_text(F.col("segments")).alias("loss"), "segments").collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(x["role"], x["text"]) for x in r["t"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
    assert chat.format_chats(df.limit(0).withColumn(
        "content", chat.text_part(F.col("text")))).count() == 0


def test_chat_parts(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "a.png", None),
                         None, ("odd", "x", None, None), ("audio", None, "b.wav", 9)]),
         (1, 1, "assistant", None)],
        "conv_id long, turn long, role string, "
        "content array<struct<type string, text string, ref string, n_tokens long>>")
    row = chat.format_chats(df).first()
    assert "see <!|image|><|image|><|audio|></s>" in row["formatted"]
    assert [tuple(a) for a in row["attachments"]] == [("image", "a.png", 576), ("audio", "b.wav", 9)]


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.NET/en/1?x=/de/"), (2, "https://a.example.net/de/"),
            (3, "https://example.com/de/a"), (4, "https://x.org/fr/"), (5, "ftp://spam.io/a.html#t"),
            (6, "https://m.spam.io/a"), (7, None), (8, "no scheme"), (9, "x://"), (9, "x://"),
            (10, "http://badexample.com/de/"), (11, "http://example.com?/de/")]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, _host string")
    listed = spark.createDataFrame([("spam.io/a",), ("spam.io/a",), (None,)], "_key string")
    judged = urls.judge(pages, urls.RULES, listed)
    assert judged.columns == [*pages.columns, "_u"]
    got = sorted((r["page_id"], r["_u"]["rule"], r["_u"]["verdict"]) for r in judged.collect())
    want = [(1, "example.net/en/", "allow"), (2, "net/", "block"), (3, "example.com/de/", "block"),
            (4, "org/fr/", "allow"), (5, None, "block"), (6, None, "block"), (7, None, "allow"),
            (8, None, "allow"), (9, None, "allow"), (9, None, "allow"), (10, None, "allow"),
            (11, None, "allow")]
    assert got == sorted(want, key=lambda r: (r[0],))
    assert urls.keep_allowed(pages, urls.RULES, listed.limit(0)).count() == 10
    assert judged.limit(0).count() == 0


# -- queries

def test_sql(spark):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    from check import rows_of, tables
    duck = tables(SF)
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, SF)
        duck.execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of(
            [d[0] for d in duck.description], duck.fetchall()), name


def test_pipeline(spark, edge_docs, no_docs):
    docs = docs_of(spark)
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, current, SF)
        assert result.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in result.collect()}
        assert set(rows) <= set(seen)
        if stage is corpus_pipeline.quality_rules:
            assert all(len(words(t)) >= 50 for t in rows.values())
        if stage is corpus_pipeline.minhash_near_dedup:
            assert len({" ".join(words(t.lower())) for t in rows.values()}) == len(rows)
        if stage is corpus_pipeline.suffix_array_dedup:
            assert set(rows) == set(seen)
        else:
            assert all(seen[d] == t for d, t in rows.items())
        current, seen = spark.createDataFrame(result.collect(), docs.schema), rows
    final = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in final.collect()} == set(seen)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edge_docs, SF).collect()
        assert stage(spark, no_docs, SF).count() == 0
