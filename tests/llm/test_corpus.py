"""Mixing, line chunks, similarity classes and the pipeline against brute force."""

import collections
import re

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.conftest import COLUMNS

from statuta.llm import bpe, components, fertility, line_chunks, mixing, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest, weights_left = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and rest * weight[s] / weights_left > most * sizes[s] + 1e-9}
        if not new:
            return {s: most * sizes[s] if s in full else rest * weight[s] / weights_left for s in names}
        full |= new


def test_mixing_meets_its_targets(odd, odd_rows, documents):
    for frame, rows in ((odd, odd_rows), (documents, [tuple(r) for r in documents.collect()])):
        size = [len(WORD.findall(r[1] or "")) for r in rows]
        sizes = collections.Counter()
        for r, n in zip(rows, size):
            sizes[r[3]] += n
        want = water(sizes)
        plan = mixing.budgets(frame).withColumnRenamed("doc_id", "id").collect()
        assert sorted((str(r.id), r["size"]) for r in plan) == sorted((str(r[0]), n) for r, n in zip(rows, size))
        taken = collections.Counter()
        for r in plan:
            assert r.taken <= 2 * r["size"]
            taken[(r.source_size, round(r.target, 4))] += r.taken
        expected = collections.Counter()
        for s, t in want.items():
            expected[(sizes[s], round(t, 4))] += int(t + 1e-9)
        assert {k: v for k, v in taken.items()} == dict(expected)
        assert sorted(map(repr, mixing.budgets(frame.repartition(3)).collect())) == sorted(map(repr, mixing.budgets(frame).collect()))


def test_mixed_rows_hold_the_words_taken(odd, documents):
    for frame in (odd, documents):
        frame = frame.withColumn("_k", F.lit(7)).withColumn("_tail", F.lit("x"))
        mixed = mixing.mix(frame)
        assert mixed.columns == frame.columns and mixed.filter("_k != 7 or _tail != 'x'").count() == 0
        words = collections.Counter()
        for r in mixed.collect():
            words[r.doc_id] += len(WORD.findall(r.text))
        plan = {r.doc_id: r.n for r in mixing.budgets(frame).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r.n}
        assert plan == {k: v for k, v in words.items() if v}


def test_empty_tables(empty, paths):
    assert mixing.budgets(empty).collect() == [] and mixing.mix(empty).collect() == []
    assert line_chunks.dedup(empty).collect() == [] and line_chunks.report(empty).collect() == []
    assert ngram_join.classes(empty).collect() == [] and ngram_join.one_of_each(empty).collect() == []


def test_passages_go_everywhere_but_first(spark):
    passage = [f"line {i} of the passage with words" for i in range(6)]
    rows = [(3, "\n".join(["own a", *passage, "own b"])), (1, "\n".join(["own c", *passage])), (2, "\n".join([*passage, "own d", "own e"])),
            (4, "own a\nanother line"), (5, passage[0]), (6, "")]
    frame = spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id long, text string, _spans long")
    kept = {r.doc_id: r.text for r in line_chunks.dedup(frame).collect()}
    assert kept[1] == rows[1][1] and kept[4] == rows[3][1] and kept[5] == passage[0] and kept[6] == ""
    assert kept[3].split("\n")[0] == "own a" and not set(kept[2].split("\n")) & set(passage[1:5]) and not set(kept[3].split("\n")) & set(passage[1:5])


def test_line_chunks_on_documents(spark):
    """No line goes that is not in a repeated pair of lines, and nearly all that are go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    seen, marked = set(), {}
    for k in sorted(before):
        lines = before[k]
        marked[k] = [False] * len(lines)
        for p in range(len(lines) - 1):
            if (lines[p], lines[p + 1]) in seen:
                marked[k][p] = marked[k][p + 1] = True
            seen.add((lines[p], lines[p + 1]))
    removed = {r.doc_id: r.n_removed for r in line_chunks.report(docs).collect()}
    assert all(removed[k] <= sum(marked[k]) for k in before)
    assert sum(removed.values()) >= 0.97 * sum(map(sum, marked.values()))


def test_odd_rows_keep_their_columns(odd, odd_rows):
    out = line_chunks.dedup(odd.withColumn("_k", F.lit(1)).withColumn("hash", F.lit("h")))
    assert out.columns == [*odd.columns, "_k", "hash"] and out.filter("_k = 1 and hash = 'h'").count() == len(odd_rows)
    texts = {r.doc_id: r.text for r in out.filter("doc_id in (1, 2, 9, 10)").collect()}
    assert texts[1] is None and texts[2] == "" and texts[9].count("\n") == 3 and texts[10].count("\n") < 3


def grams(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows, threshold=0.8):
    sets = [grams(t) for _, t, *_ in rows]
    parent, links, held = list(range(len(rows))), [0] * len(rows), collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in held[g])
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            held[g].append(i)
    members = collections.defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    least = {c: None if None in m else min(m) for c, m in members.items()}
    return [(r[0], least[find(i)], links[i]) for i, r in enumerate(rows)]


def near_rows(n=400):
    """A large group of near copies with any similarity, exact copies, and others."""
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        own = [w for k, w in enumerate(words) if (k * 7919 + i * 104_729) % 151 > i % 9]
        rows.append((i, " ".join(own) + ("" if i % 3 else f" tail{i}")))
    rows += [(n + i, "copied text of a handful words only") for i in range(50)]
    return rows + [(n + 50 + i, f"other words {i} and {i * 3} with number {i * 5} inside {i * 7} text") for i in range(60)]


def test_classes_are_those_of_all_pairs(spark, odd, odd_rows, documents):
    near = spark.createDataFrame(near_rows(), "doc_id long, text string")
    for frame, rows in ((near, near_rows()), (odd, odd_rows), (documents, [tuple(r) for r in documents.collect()])):
        got = [tuple(r) for r in ngram_join.classes(frame).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_classes(rows)))


def test_one_row_of_each_class_stays(spark, odd, odd_rows):
    rows = near_rows()
    frame = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, sid long")
    kept = [tuple(r) for r in ngram_join.one_of_each(frame).collect()]
    assert sorted(kept) == sorted((c, dict(rows)[c], c) for c in {c for _, c, _ in brute_classes(rows)})
    stays = ngram_join.one_of_each(odd).collect()
    assert len(stays) == len(odd_rows) - 2  # one of two equal rows, one of two near copies


def test_pruning_bound():
    assert ngram_join.least_matches(16, 0.8, 1e-6) > 0 and ngram_join.least_matches(128, 0.8, 1e-6) > 60
    assert all(ngram_join.least_matches(n, 0.8, 1e-6) <= 0.8 * n for n in range(16, 129, 16))


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500 + i, 900) for i in range(80)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 580), 500), 900: 500}


def test_pipeline_stages(spark, odd_rows, tmp_path, paths):
    """Each stage on its own input, and the whole run, against plain computations."""
    parts = "water house mountain garden letter window silver river paper summer winter market bridge forest island".split()
    word = lambda n: parts[n % 15] + parts[n // 15 % 15]
    prose = [(100 + i, " ".join(word(i * 31 + k * 17) for k in range(40)) + "\nlast line here", "en", f"s{i % 4}", 1) for i in range(30)]
    copies = [(200 + i, prose[0][1] + f" {i}", "en", "s1", 1) for i in range(3)]
    folder = tmp_path / "sf"
    spark.createDataFrame([*odd_rows, *prose, *copies], COLUMNS).write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    (_, rules), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    one = rules(spark, docs, str(folder))
    verdict = sorted(str(r.doc_id) for r in fertility.measure(docs, paths["piece_bpe_32k.model"]).filter("kept").collect())
    assert sorted(str(r.doc_id) for r in one.collect()) == verdict and {r[0] for r in prose} <= {r.doc_id for r in one.collect()}
    two = lines(spark, one, str(folder))
    assert two.count() == one.count() and two.filter("n_chars != length(text)").count() == 0
    three = near(spark, two, str(folder))
    rows = [tuple(r) for r in two.select("doc_id", "text").collect()]
    empty_ids = [k for k, t in rows if not WORD.search(t)]
    assert sorted(str(r.doc_id) for r in three.collect()) == sorted(map(str, [*{c for k, c, _ in brute_classes(rows) if k not in empty_ids}, *empty_ids]))
    four = mix(spark, three, str(folder))
    assert all(s.columns == corpus_pipeline.COLUMNS for s in (one, two, three, four))
    five = encode(spark, four, str(folder))
    assert five.count() == four.count()
    whole = corpus_pipeline.run(spark, str(folder))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, bpe.round_trip(four, paths["byte_bpe_50k.json"]).collect()))


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
