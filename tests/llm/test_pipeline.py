"""The pipeline's stages against plain Python, on rows with nulls, repeated ids and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline

own = random.Random(9)
VOCABULARY = ["".join(own.choice("abcdefgh") for _ in range(own.randint(2, 6))) for _ in range(200)]
PASSAGE = " ".join(VOCABULARY[20:34])
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, own_id string, shared string, text_hash int"


def prose(n):
    return " ".join(own.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, other = prose(150), prose(120)
    texts = [base, base, base + " " + VOCABULARY[3], other, None, "", "", prose(80) + " " + PASSAGE, prose(30), prose(4) + ". " + PASSAGE.upper() + "."]
    texts += [prose(60) + (" scumm lozer idyot" if k % 4 == 0 else ". Mr. John Smith mails a@b.com" if k % 4 == 1 else "") for k in range(400)]
    out = [(k, t) for k, t in enumerate(texts)]
    return out + [(3, prose(90)), (3, other), (None, prose(70)), (None, prose(60) + ". Mr. John Smith mails a@b.com")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    whole = [(k, t, "en", "x", len(t or ""), "row", "own", "shared", 1) for k, t in rows]
    spark.createDataFrame(whole, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE.replace(" ", ", ", 3)), (2, None), (None, "never")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 0, int("scumm" in t)) for k, t in rows if k is not None and 10 <= k < 410], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def words(text):
    return (text or "").lower().split()


def near(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (words(a), words(b))]
    return bool(sets[0]) and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def test_stages(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns
    left = texts(clean)
    held = [(k, t) for k, t in rows if k is not None and 10 <= k < 410 and zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(((k, t) in left) == ("scumm" not in t) for k, t in held) > 0.95 * len(held)
    assert {(k, t) for k, t in rows if not (k is not None and 10 <= k < 410)} <= {*left}

    alone = corpus_pipeline.drop_near_duplicates(spark, clean, folder)
    assert alone.columns == docs.columns
    want, reached = [], set()
    for at, (k, t) in enumerate(left):
        if at in reached:
            continue
        group, todo = {at}, [at]
        while todo:
            x = todo.pop()
            more = {y for y in range(len(left)) if y not in group and near(left[x][1], left[y][1])}
            group |= more
            todo += more
        reached |= group
        want.append({left[y] for y in group})
    kept = texts(alone)
    assert len(kept) == len(want) and all(len(g & {*kept}) >= 1 for g in want)
    assert (0, rows[0][1]) in kept and (1, rows[1][1]) not in kept and sum(k == 3 for k, _ in kept) == 2

    free = corpus_pipeline.drop_contaminated(spark, alone, folder)
    passage = PASSAGE.split()

    def leaks(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        return any(w[p : p + 10] == passage[q : q + 10] for p in range(len(w) - 9) for q in range(len(passage) - 9)) or "never" in w
    assert texts(free) == sorted(((k, t) for k, t in kept if not leaks(t)), key=repr) and len(kept) - free.count() == 2

    named = corpus_pipeline.replace_personal_data(spark, free, folder)
    after = {r.doc_id: r for r in named.where("text like '%Mr.%'").collect()}
    assert named.columns == docs.columns and named.count() == free.count()
    assert "Smith" not in after[None].text and "a@b.com" not in after[None].text and after[None].n_chars == len(after[None].text)
    untouched = {x for x in texts(free) if "Smith" not in (x[1] or "")}
    assert untouched <= {*texts(named)}

    ids = corpus_pipeline.to_token_ids(spark, named, folder).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t or ""))).hexdigest()
    plain = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in ids) == sorted((str(k), digest(t), plain(t)) for k, t in texts(named))


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = [sorted(str((r.doc_id, r.n_tokens, r.ids_sha256)) for r in df.collect()) for df in (docs, corpus_pipeline.run(spark, folder))]
    assert got[0] == got[1] and len(got[0]) > 250


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
