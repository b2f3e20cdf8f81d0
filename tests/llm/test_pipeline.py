"""The pipeline's stages, one by one, against plain versions, on the smallest driver documents with some rows added."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_ops import plain_lines, plain_print
from trustloom.llm import decontaminate, scratch, simhash
from trustloom.llm.components import components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.filter("doc_id in (1, 2)")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, "12 34", "de", "s", 5), (None, "Is and retitioning ouen the of, nterti thorreou ndernt. Ndble whst the by for and threea.", "en", "s", None)], docs.schema)
    out = [scratch.stored(docs.unionByName(again).unionByName(odd), "docs")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.stored(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_language_keeps_clean_documents(stages):
    before, after = stages[0].collect(), stages[1].collect()
    gone = Counter(before) - Counter(after)
    assert not Counter(after) - Counter(before)
    assert {(r.doc_id, r.text) for r in gone} >= {(None, None), (9001, ""), (9002, "12 34")}
    assert sum(gone.values()) <= 3 + 0.02 * len(before)


def test_lines(stages):
    before, after = stages[1].collect(), stages[2].collect()
    drop = plain_lines([(r.doc_id, r.text) for r in before])
    want = Counter()
    for r in before:
        key = 2**63 - 1 if r.doc_id is None else r.doc_id
        text = "\n".join(x for n, x in enumerate(r.text.split("\n")) if (key, n, tuple(x.split())) not in drop)
        want[r.doc_id, text, r.lang, len(text)] += 1
    assert Counter((r.doc_id, r.text, r.lang, r.n_chars) for r in after) == want


def test_one_of_each(stages):
    before, after = stages[2].collect(), stages[3].collect()
    prints = {r.text: plain_print(r.text, corpus_pipeline.SHINGLE) for r in before}
    values = sorted(set(prints.values()))
    root = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = {k: new if r == old else r for k, r in root.items()}
    groups: dict[int, list] = {}
    for r in before:
        groups.setdefault(root[prints[r.text]], []).append(r.doc_id)
    kept = Counter(root[prints[r.text]] for r in after)
    assert kept == Counter(groups.keys())
    for r in after:
        ids = [i for i in groups[root[prints[r.text]]] if i is not None]
        assert r.doc_id == min(ids, default=None)


def test_one_of_each_takes_edited_copies(spark):
    """Copies with similarities about 0.8, whose fingerprints differ by more than four bits mostly, as plain Jaccard says."""
    rnd = random.Random(11)
    say = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    data = []
    for k in range(40):
        base = say(rnd.choice((30, 120, 400)))
        data += [(len(data), " ".join(base)), (len(data) + 1, " ".join(base).upper())]
        for _ in range(2):
            own = list(base)
            for _ in range(max(1, rnd.randrange(len(base) // 30 + 2))):
                own[rnd.randrange(len(own))] = say(1)[0]
            data.append((len(data), " ".join(own)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in data for w in [t.lower().split()]}
    root = {i: i for i in sets}
    wide = 0
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                wide += (plain_print(data[i][1], 5) ^ plain_print(data[j][1], 5)).bit_count() > 4
                root = {k: root[j] if r == root[i] else r for k, r in root.items()}
    assert wide > 10
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.keep_one_of_each(spark, df, SF).collect()
    want = {min(i for i in root if root[i] == r) for r in set(root.values())}
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert all(data[r.doc_id][1] == r.text for r in got)


def test_similar_parts(spark, monkeypatch):
    """Tiles and parts of a few members give the same as whole ones."""
    monkeypatch.setattr(simhash, "PART", 3)
    base = [f"w{i}" for i in range(200)]
    data = [(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(20)]
    df = spark.createDataFrame([*data, (50, "other words"), (51, ""), (52, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [0, 50, 51]


def test_long_texts_without_shared_shingles_are_no_candidates(spark):
    """Of long texts, counts by residue and wide fingerprints tell little: at many of them all were one component, and all its sets met."""
    rnd = random.Random(2)
    data = [(" ".join(f"w{rnd.randrange(9999)}" for _ in range(2500)),) for _ in range(250)]
    prints = [plain_print(t, 5) for (t,) in data]
    assert any((a ^ b).bit_count() <= simhash.WIDE_RADIUS for i, a in enumerate(prints) for b in prints[:i])
    signed = spark.createDataFrame(data, "text string").select(simhash.signatures("text", 5).alias("s")).select("s.*")
    assert simhash.candidates(signed, simhash.WIDE_RADIUS, 0.8).count() == 0
    twice = spark.createDataFrame([*data, *[(t + " end",) for (t,) in data[:9]]], "text string").select(simhash.signatures("text", 5).alias("s")).select("s.*")
    for tile in (4096, 1):
        assert len({frozenset(r) for r in simhash.candidates(twice, simhash.WIDE_RADIUS, 0.8, tile).collect()}) == 9


def test_parts_that_meet_again(spark, monkeypatch):
    """Groups of copies that only a member of another part links, and members that are like none, in parts of a few members: as one part says."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    edit = lambda w, n: [f"x{rnd.randrange(10**6)}" if i in rnd.sample(range(300), n) else v for i, v in enumerate(w)]
    data = []
    for _ in range(12):
        own = edit(base, 4)
        data += [own, *[edit(own, rnd.randrange(1, 9)) for _ in range(5)]]
    sets = [np.unique(np.array([hash(tuple(w[i : i + 5])) % 2**64 for i in range(296)], "<u8")) for w in data]
    rows = [(7, i, s.tobytes()) for i, s in enumerate(sets)]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both):
                label = [label[j] if x == label[i] else x for x in label]
    want = {frozenset(i for i, x in enumerate(label) if x == r) for r in set(label)}
    assert 1 < len(want) < len(sets)
    members = spark.createDataFrame(rows, "root long, node long, shingles binary")
    for part in (512, 20, 4, 2):
        monkeypatch.setattr(simhash, "PART", part)
        found = {r.node: r.root for r in components(simhash.similar_links(members, 0.8), "a", "b").collect()}
        assert {frozenset(k for k in range(len(sets)) if found.get(k, k) == r) for r in {found.get(k, k) for k in range(len(sets))}} == want


def test_leaks(spark, stages):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = decontaminate.Items(bench).items
    kept = Counter(stages[4].collect())
    for r in stages[3].collect():
        words = decontaminate.word_keys([r.text])[0].tolist()
        leak = any(decontaminate.best_stretch(p, words)[0] <= int(len(p) * 0.2 + 1e-9) for _, p in items if set(p) & set(words))
        assert (kept[r] == 0) == leak


def test_tokens(stages):
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in stages[5].collect()) == want


def test_empty_and_repeated_null_ids(spark, stages):
    null = stages[0].filter(F.col("doc_id").isNull() & F.col("text").isNotNull())
    assert corpus_pipeline.keep_one_of_each(spark, null.union(null), SF).count() == 1
    none = stages[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
