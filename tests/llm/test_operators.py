"""Operators as Spark jobs: odd rows, and brute force on small tables."""

import textwrap
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vertexloom.llm import cap_filters, dart_minhash, language_id, licence_templates, licenses, line_dedup, packing, pstable_ann, quality, queries, token_store, vectors
from vertexloom.operators.scratch import Scratch, scratch_root

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string"
PROSE = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of the wood " * 4
ROWS = [
    (1, PROSE + "\nown line here", "en", "a", 1, 0.0, ""),
    (2, PROSE + "\nanother line", "en", "a", 1, 0.0, ""),
    (2, PROSE + "\nanother line", "en", "a", 1, 0.0, ""),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 0.0, ""),
    (None, "no id at all, but some words", "en", "b", 0, 0.0, ""),
    (5, "word " * 60_000, "en", "b", 0, 0.0, ""),
    (6, "12 34 !!", None, "b", 0, 0.0, ""),
    (7, "Licensed under the Apache License, Version 2.0.\nfine", "en", "b", 0, 0.0, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language(spark, odd, docs):
    model = language_id.fit_languages(docs)
    found = odd.select("doc_id", language_id.language_labels(odd, model).alias("f")).select("doc_id", "f.*").collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(ROWS)
    assert by[3]["lang"] == by[4]["lang"] == by[6]["lang"] == "und" and by[6]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found) and by[1]["lang"] in model.languages
    assert language_id.fit_languages(docs.limit(0)).languages == ()
    rows = queries.language(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.9


def test_spans_of_a_mixed_text(spark, docs):
    model = language_id.fit_languages(docs)
    long = {r["lang"]: r["text"] for r in docs.where("length(text) > 800").select("lang", "text").collect()}
    text = " ".join(long["en"].split()[:80] + long["de"].split()[:80])
    _, score, spans = language_id.Labeller(model).labels([text])[0]
    assert {s[0] for s in spans} >= {"en", "de"} and spans[0][1] == 0 and spans[-1][2] == 159 and score < 1


def test_quality(spark, odd, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    scores = odd.select(quality.quality_score(odd, model).alias("s")).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["s"] <= 1 for r in scores)
    one = quality.fit_quality(docs, labels.where("quality = 1"))
    assert odd.select(quality.quality_score(odd, one).alias("s")).distinct().count() == 1
    assert quality.fit_quality(docs, labels.limit(0)).offset == 0


def _removed_by_brute_force(rows, min_words):
    """Lines in a run of enough words that stands at an earlier place."""
    texts = {}
    for doc_id, text in rows:
        if text is not None:
            lines = [(i, " ".join(x.split())) for i, x in enumerate(text.split("\n")) if x.split()]
            texts[(doc_id, text)] = lines
    places = [(k, p) for k, lines in texts.items() for p in range(len(lines))]
    gone = {}
    for k, lines in texts.items():
        for a in range(len(lines)):
            for k2, b in places:
                if ((k2[0] is not None, k2[0] or 0), b) < ((k[0] is not None, k[0] or 0), a) and (k2 == k or k2[0] != k[0]):
                    n = words = 0
                    while a + n < len(lines) and b + n < len(texts[k2]) and lines[a + n][1] == texts[k2][b + n][1]:
                        words += len(lines[a + n][1].split())
                        n += 1
                    if words >= min_words:
                        gone.setdefault(k, set()).update(lines[a + i][0] for i in range(n))
    return gone


def test_line_dedup(spark, odd):
    rng = np.random.default_rng(8)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in rng.integers(1, 15, 40)]
    rows = [(int(i), "\n".join(pool[j] for start in rng.integers(0, 36, 4) for j in range(start, start + 4))) for i in range(60)]
    rows += [(100, pool[0] + "\n" + " \n" + pool[1]), (101, None), (102, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"]): r for r in line_dedup.dedup_lines(table, Scratch(spark), 20).collect()}
    gone = {k[0]: v for k, v in _removed_by_brute_force(rows, 20).items()}
    for doc_id, text in rows:
        assert set(found[doc_id]["__removed"]) == gone.get(doc_id, set())
        if text is not None:
            kept = [x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc_id, set())]
            assert found[doc_id]["text"] == "\n".join(kept)
    out = line_dedup.dedup_lines(odd, Scratch(spark)).collect()
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in out if r["text"])
    assert len(out) == len(ROWS) and texts.count((2, "another line")) == 2
    assert line_dedup.dedup_lines(odd.limit(0), Scratch(spark)).count() == 0


def _classes_by_brute_force(rows, threshold):
    sets = [dart_minhash.document_elements(t, False) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or dart_minhash.similarity(sets[i], sets[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    return [min((x for x in ids[find(i)] if x is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("block", [1_000, 7])
def test_near_duplicates(spark, block):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    rows = []
    for i in range(60):  # a family whose members are linked to some of the others only
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"n{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{x}" for x in rng.integers(0, 10_000, 80))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "a b"), (203, "a b"), (None, "a b"), (204, rows[60][1]), (204, rows[60][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = dart_minhash.near_duplicates(table, Scratch(spark), block=block).collect()
    expected = sorted(((r[0] if r[0] is not None else -1), c) for r, c in zip(rows, _classes_by_brute_force(rows, 0.8)))
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["class_id"]) for r in found) == expected


def test_near_duplicates_of_odd_rows(spark, odd):
    assert dart_minhash.near_duplicates(odd, Scratch(spark)).count() == len(ROWS)
    assert dart_minhash.near_duplicates(odd.limit(0), Scratch(spark)).count() == 0
    assert dart_minhash.near_duplicates(odd, Scratch(spark), weighted=True).count() == len(ROWS)


def test_licenses(spark, odd):
    files = odd.withColumn("path", F.when(F.col("doc_id") == 7, "x/LICENSE").when(F.col("doc_id") == 4, "x/y/a.txt").when(F.col("doc_id") == 5, "z/b.txt"))
    found = {r["doc_id"]: r for r in licenses.find_licenses(files, Scratch(spark)).collect()}
    assert (found[7]["license"], found[7]["origin"], found[7]["score"]) == ("Apache-2.0", "own", 1.0)
    assert (found[4]["license"], found[4]["origin"], found[4]["license_path"]) == ("Apache-2.0", "inherited", "x/LICENSE")
    assert found[5]["origin"] == found[3]["origin"] == "none"
    assert licenses.find_licenses(files.limit(0), Scratch(spark)).count() == 0


def test_licenses_with_hot_notices_and_directories(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [("a/LICENSE", "x\nReleased under the MIT License\ny"), ("a/b/LICENSE", notice), (None, None), (None, notice), ("a/LICENSE", None)]
    rows += [(f"a/{i}.txt", notice if i % 2 else "plain") for i in range(40)] + [(f"a/b/{i}.txt", "") for i in range(10)] + [("c/d.txt", "plain")] * 3
    files = spark.createDataFrame(rows, "path string, text string")
    plain = sorted(licenses.find_licenses(files, Scratch(spark)).collect(), key=str)
    sliced = sorted(licenses.find_licenses(files, Scratch(spark), hot_rows=3).collect(), key=str)
    assert sliced == plain and len(plain) == len(rows)
    inherited = {r["path"]: (r["license"], r["license_path"]) for r in plain if r["origin"] == "inherited"}
    assert inherited["a/0.txt"] == ("MIT", "a/LICENSE") and inherited["a/b/0.txt"] == ("Apache-2.0", "a/b/LICENSE")
    assert {r["origin"] for r in plain if r["path"] == "c/d.txt"} == {"none"}


@pytest.mark.parametrize("copies", [3, 100_000])
def test_frequent_notices_keep_their_licence(spark, copies):
    notices = ["All rights reserved.", "Copyright, all rights reserved", "Released under the MIT License"]
    rows = [(n, n) for n in notices] + [("mixed", "All rights reserved.\nReleased under the MIT License")]
    files = spark.createDataFrame(rows, "kind string, text string").join(spark.range(copies)).withColumn("path", F.concat_ws("/", "kind", F.concat("id", F.lit(".txt"))))
    found = {r["kind"]: r for r in licenses.find_licenses(files, Scratch(spark)).groupBy("kind").agg(F.collect_set("license").alias("of"), F.count("license").alias("n")).collect()}
    assert {k: (r["of"], r["n"]) for k, r in found.items()} == {k: ([v], copies) for k, v in zip([*notices, "mixed"], ["Proprietary", "Proprietary", "MIT", "MIT"])}


def test_licences_by_whole_texts_headers_and_ids(spark):
    text = dict(reversed(licence_templates.texts()))
    gpl = "\n".join(f" * {x}" for x in textwrap.wrap("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", 60))
    wanted = {
        "a/LICENSE": ("GNU GPL v3", "GPL-3.0"),
        "b/COPYING": (text["GPL-3.0"], "GPL-3.0"),
        "c/LICENSE": ("Copyright (c) 2020 Jane Doe\n\n" + text["MIT"].partition("\n")[2], "MIT"),
        "d/LICENSE": ("Copyright 2020 Jane Doe\nAll rights reserved.\n\n" + text["BSD-3-Clause"], "BSD-3-Clause"),
        "e/x.py": ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"),
        "f/x.c": ("// SPDX-License-Identifier: Apache-2.0\nint main;\n", "Apache-2.0"),
        "g/x.c": (f"/* Adder of numbers\n *\n{gpl}\n */\nint main;\n", "GPL-3.0"),
        "h/LICENSE": (text["AGPL-3.0"], "AGPL-3.0"),
        "i/LICENSE": ("some words of prose about the sea", None),
        "j/x.py": ("# SPDX-License-Identifier: Foo-7\n# the driving license of a child\nx = 1", None),
        "k/LICENSE": (text["Apache-2.0"], "Apache-2.0"),
        "l/LICENSE": (text["BSD-2-Clause"], "BSD-2-Clause"),
        "m/LICENSE": (text["LGPL-3.0"], "LGPL-3.0"),
    }
    files = spark.createDataFrame([(p, t) for p, (t, _) in wanted.items()], "path string, text string")
    found = {r["path"]: r["license"] for r in licenses.find_licenses(files, Scratch(spark)).collect()}
    assert found == {p: licence for p, (_, licence) in wanted.items()}


def test_tokens_packed_stored_and_read(spark, odd):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(odd).collect()
    path = f"{scratch_root(spark)}/test-tokens"
    token_store.write_store(odd, path)
    stored = token_store.read_documents(spark, path).collect()
    assert len(stored) == len(ROWS)
    total = 0
    for r in sorted(stored, key=lambda r: r["start"]):
        assert r["start"] == total
        total += r["n_tokens"]
    text = {r[0]: r[1] for r in ROWS}
    for r in stored:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
    assert sum(p["length"] for p in pieces) == total
    for p in pieces:
        ids = np.array(library.encode(text[p["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4")
        assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert packing.pack_documents(odd.limit(0)).count() == 0
    token_store.write_store(odd.limit(0), path + "-empty")
    assert token_store.read_digests(spark, path + "-empty").count() == 0


def test_byte_bpe_of_odd_rows(spark, odd):
    from vertexloom.llm import byte_bpe

    rows = byte_bpe.encode_documents(odd, ids=True).collect()
    assert len(rows) == len(ROWS) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert byte_bpe.encode_documents(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[100] + 0.1 * rng.normal(size=(40, 16))
    x[200:260] = x[200]  # copies
    x[261] = 3 * x[260]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [None] + [1.0] * 15), (403, [float("nan")] * 16), (404, []), (405, [float("inf")] * 16), (406, [1.0, 2.0])]
    return x, spark.createDataFrame(rows, "vec_id long, v array<double>")


def test_links(spark, points):
    x, table = points
    found = {r["vec_id"]: r for r in cap_filters.cosine_links(table, Scratch(spark), filter_rows=20, block=16).collect()}
    near = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9
    np.fill_diagonal(near, False)
    got = np.array([found[i]["n_links"] for i in range(300)])
    assert (got <= near.sum(1)).all() and got.sum() >= 0.97 * near.sum()
    assert len({found[i]["component_id"] for i in range(200, 260)}) == 1 and found[261]["component_id"] == 260
    for i in range(400, 407):
        assert (found[i]["n_links"], found[i]["component_id"]) == (0, i)
    assert cap_filters.cosine_links(table.limit(0), Scratch(spark)).count() == 0


def test_nearest(spark, points):
    x, table = points
    found = pstable_ann.nearest(table, Scratch(spark), F.col("vec_id") % 10 == 0, block=16).collect()
    hits = total = 0
    for q in range(0, 300, 10):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        scores = (x[q] * x).sum(1)
        best = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:20]
        assert len(own) == 20 and [r["rank"] for r in own] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-12) for r in own)
        hits += len(set(best) & {r["vec_id"] for r in own})
        total += 20
    assert hits / total >= 0.9
    assert not [r for r in found if r["query_id"] >= 400 or r["vec_id"] >= 400]
    assert pstable_ann.nearest(table.where("vec_id < 5"), Scratch(spark), F.col("vec_id") >= 0).count() == 20
    assert pstable_ann.nearest(table.limit(0), Scratch(spark), F.col("vec_id") >= 0).count() == 0


def test_nearest_deals_many_queries_of_one_bucket(spark, monkeypatch):
    rows = vectors.of_rows(spark.range(1, 600).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("v")), "id", "v")
    rows = rows.unionByName(spark.createDataFrame([(600, [1e6] * 8)], "vec_id long, v array<double>"))  # all others lie in a few cells
    dealt = []

    def deal(*args):
        dealt.append(own(*args))
        return dealt[-1]

    own = pstable_ann._deal
    monkeypatch.setattr(pstable_ann, "_deal", deal)
    whole = sorted(pstable_ann.nearest(rows, Scratch(spark), F.col("vec_id") >= 0).collect())
    parts = sorted(pstable_ann.nearest(rows, Scratch(spark), F.col("vec_id") >= 0, block=50, queries_at_once=50).collect())
    monkeypatch.setattr(pstable_ann, "HELD_ROWS", 100)
    assert sorted(pstable_ann.nearest(rows, Scratch(spark), F.col("vec_id") >= 0, block=50, queries_at_once=50).collect()) == parts
    assert parts == whole and len(parts) == 600 * 20
    most = [asked.groupBy("g", "part").count().agg(F.max("count")).first()[0] for _, asked in dealt]
    assert most[0] > 300 and max(n for n in most[1:] if n) < 100


def test_recall_of_registered_search(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    found = queries.nearest_vectors(spark, FOLDER).collect()
    hits = 0
    for q in range(0, len(x), 20):
        scores = (x[q] * x).sum(1)
        best = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        hits += len(set(best) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits >= 0.9 * len(found) and len(found) == 20 * len(range(0, len(x), 20))


def test_pipeline(spark, docs):
    stages, columns, before = dict(corpus_pipeline.STAGES), docs.columns, docs
    scratch = Scratch(spark)
    for name in list(stages)[:-1]:
        after = scratch.save(stages[name](spark, before, FOLDER), name.replace(" ", "-"))
        assert after.columns == columns
        lost = before.join(after, "doc_id", "left_anti").count()
        assert before.count() - after.count() == lost
        before = after
    classes = dart_minhash.near_duplicates(before, scratch)
    assert classes.count() == classes.select("class_id").distinct().count()
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_stages_take_odd_rows(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
        assert out.count() <= len(ROWS)


def test_near_copies_without_ids_leave_one(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words + ["more"]), " ".join(words), "something else entirely", None]
    table = spark.createDataFrame([(None, t, "en", "s", 1) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["text"] for r in corpus_pipeline.keep_one_of_each(spark, table, FOLDER).collect()]
    assert len(kept) == 3 and len([t for t in kept if t and t.startswith("w0")]) == 1
    named = table.unionByName(table.limit(1).withColumn("doc_id", F.lit(5).cast("long")))
    kept = corpus_pipeline.keep_one_of_each(spark, named, FOLDER).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 5]


def test_loss_bearing_tokens_are_a_limit_of_their_own(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        ask, answer = (" ".join(["word"] * int(n)) for n in rng.integers(1, 60, 2))
        rows.append((i, [(ask, False), (answer, True)] * int(rng.integers(1, 4)), "x"))
    rows += [(900, None, "x"), (901, [], "x"), (902, [(None, True), None, ("a b", None)], "x"), (None, [("long " * 3000, True)], "x")]
    table = spark.createDataFrame(rows, "doc_id long, parts array<struct<text: string, loss: boolean>>, length string")
    limits = packing.Limits(tokens=512, segments=16, loss_tokens=200)
    found = packing.pack_examples(table.coalesce(1), limits=limits).collect()
    by_sequence, by_document = {}, {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_document.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        assert sum(p["length"] for p in pieces) <= 512 and len(pieces) <= 16 and sum(p["loss_tokens"] for p in pieces) <= 200
    near = [sum(p["loss_tokens"] for p in pieces) for pieces in by_sequence.values()]
    assert np.mean([n > 180 for n in near]) > 0.8  # the limit that ends most sequences
    for i, parts, _ in rows[:200]:
        loss = sum(len(t.split()) for t, marked in parts if marked) + 1
        assert sum(p["loss_tokens"] for p in by_document[i]) == loss
        assert len(by_document[i]) == 1 or loss > 200
    assert [p["length"] for p in by_document[900] + by_document[901]] == [1, 1]
    assert by_document[902][0]["loss_tokens"] == 0 and sum(p["length"] for p in by_document[None]) > 3000
