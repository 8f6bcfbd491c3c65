"""The pipeline's stages on a small folder of tables, each against what it should do to its own input."""

import random

import corpus_pipeline
from test_llm import prose


def test_stages(spark, tmp_path):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(80):
        text = prose(r, 60)
        bad = k % 4 == 0
        rows.append((k, " ### ".join(text.split(" ")) if bad else text, "en", f"s{k % 3}", 0))
        labels.append((k, int(not bad), 0))
    copy = rows[1][1]
    rows += [(100 + k, copy, "en", "s1", 0) for k in range(5)]
    rows.append((200, prose(r, 40) + " password=abcdefghijklmnop " + prose(r, 20), "en", "s2", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        tables.append(docs)
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    ids = [sorted(x.doc_id for x in t.select("doc_id").collect()) for t in tables]
    clean = sorted(i for i, *_ in rows if i >= 80 or i % 4)
    assert ids[0] == clean
    assert ids[1] == [i for i in clean if not 100 <= i < 105]
    assert ids[2] == ids[1]
    text = tables[2].where("doc_id = 200").first().text
    assert "password" not in text and "[SECRET]" in text
    assert set(ids[3]) <= set(ids[2])
    assert set(ids[4]) == set(ids[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tables[-1].collect()))


def test_edited_near_copies_leave_the_pipeline(spark):
    """Copies edited up to a similarity of 0.8 go, also when more than 4 bits of op1's fingerprints differ; others stay."""
    r = random.Random(23)
    rows, want = [], set()
    sets = {}
    for base in range(12):
        words = prose(r, 150).split(" ")
        for copy in range(5):
            own = list(words)
            for at in r.sample(range(10, 140), copy):
                own[at] = f"edit{base}x{copy}x{at}"
            rows.append((base * 10 + copy, " ".join(own), "en", "s0", 0))
            sets[rows[-1][0]] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
    rows += [(500, None, "en", "s0", 0), (501, "", "en", "s0", 0), (None, rows[0][1], "en", "s0", 0), (502, "one two", "en", "s0", 0)]
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    want = {top(i) for i in sets} | {500, 502, None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want
    assert len(want) < 25  # most copies are similar enough


def test_stages_on_odd_rows_and_on_none(spark, tmp_path):
    """Null ids, texts and sources, empty and very long texts, repeated rows and ids; then no rows at all."""
    r = random.Random(31)
    good = [prose(r, 60) for _ in range(6)]
    odd = [(None, good[0], "en", None, 0), (None, good[0], "en", None, 0), (1, good[1], None, "s", 0), (1, good[2], "en", "s", None), (1, good[1], None, "s", 0), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, prose(r, 30_000), "en", "t", 0), (5, " \n\t", "en", None, 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, str(tmp_path)).cache()
            n = docs.count()
            if not rows:
                assert n == 0, name
            elif name == "quality rules":
                assert sorted(str(x.doc_id) for x in docs.collect()) == sorted(["None", "None", "1", "1", "1", "4"])
            elif name == "SimHash near-dedup":  # rows without an id stay, unlike texts of one id are judged each
                assert sorted((str(x.doc_id), x.text) for x in docs.collect()) == sorted([("None", good[0]), ("None", good[0]), ("1", good[1]), ("1", good[2]), ("4", odd[7][1])])
            elif name == "secret scans":
                assert n == before.count()
            elif name == "packing":
                assert {x.doc_id for x in docs.collect()} == {x.doc_id for x in before.collect()}


def test_near_dedup_keeps_columns_of_any_name(spark):
    r = random.Random(32)
    text = prose(r, 80)
    docs = spark.createDataFrame([(1, text, "a", 1, 2, 3), (2, text, "b", 1, 2, 3), (3, prose(r, 80), "c", 1, 2, 3)], "doc_id long, text string, row string, digest int, print int, root int")
    from tilewright.llm import resemblance, simhash

    for finder in (simhash.near_duplicates, resemblance.near_duplicates):
        kept = simhash.one_of_each(docs, finder)
        assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 3]


def test_near_dedup_goes_by_simhash_and_by_resemblance(spark):
    """Texts that op1 links leave even where no resemblance of 0.8 does; components run over links of both kinds."""
    from tilewright.llm import resemblance, simhash

    r = random.Random(47)
    found = []
    while not found:  # a pair of short texts within 4 bits whose five-word shingles are less alike than 0.8
        words = prose(r, 40).split(" ")
        for at in range(len(words)):
            own = words[:at] + [f"edit{r.random()}"] + words[at + 1 :]
            one, two = (simhash.fingerprint(" ".join(x).encode()) for x in (words, own))
            a, b = (set(resemblance.shingles(" ".join(x).encode()).tolist()) for x in (words, own))
            if (one ^ two).bit_count() <= 4 and len(a & b) * 5 < len(a | b) * 4:
                found = [" ".join(words), " ".join(own)]
                break
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    far = found[1] + " " + prose(r, 4)  # like the second by its shingles
    rows = [(1, found[0], "en", "s", 0), (2, found[1], "en", "s", 0), (3, far, "en", "s", 0), (4, prose(r, 40), "en", "s", 0), (None, found[0], "en", "s", 0)]
    docs = spark.createDataFrame(rows, kind)
    assert sorted(x.doc_id for x in resemblance.near_duplicates(docs).where("doc_id = component_id").collect()) == [1, 2, 4]
    kept = [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(map(str, kept)) == ["1", "4", "None"]
