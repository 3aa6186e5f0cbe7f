"""The pipeline on a small table, stage by stage against plain Python."""

import random
from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_texts import SPACE, lower, plain_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make_docs():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(rnd.choice(words) for _ in range(12)) for _ in range(n))
    docs = {}
    for k in range(40):
        docs[k] = prose(rnd.randint(4, 30)) + ("\nAll rights  of this TEXT are kept" if k < 12 else "")
    docs[40] = docs[3]  # an exact copy, with the shared line
    docs[41] = docs[20].replace(" ", "  ", 3)  # the same words
    docs[42] = "too short"
    docs[43] = " ".join(["again and again"] * 60)
    docs[44] = None
    docs[45] = ""
    docs[46] = prose(6) + "\nwrite to jane.doe@mail.example.org or +1 (310) 555-4510 now"
    docs[47] = prose(300)
    return docs


def test_stages(spark, tmp_path):
    docs = make_docs()
    rows = [(k, t, "en", "a", None if t is None else len(t), "extra") for k, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality rules", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    stages = dict(cp.STAGES)
    get = lambda df: {r.doc_id: r.text for r in df.collect()}

    one = stages["quality rules"](spark, table, str(tmp_path))
    assert one.columns == COLUMNS
    kept = get(one)
    assert set(kept) == set(docs) - {42, 43, 44, 45}

    two = stages["line dedup"](spark, one, str(tmp_path))
    assert two.columns == COLUMNS and all(r.n_chars == len(r.text) for r in two.collect())
    key = lambda x: lower(x.strip(SPACE))
    seen = Counter(k for t in kept.values() for k in {key(x) for x in t.split("\n")} if k)
    want = {d: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for d, t in kept.items()}
    assert get(two) == want and not any("rights" in t for t in want.values())

    three = stages["SimHash near-dedup"](spark, two, str(tmp_path))
    fps = {d: plain_simhash(t) for d, t in want.items()}
    least = {d: d for d in fps}
    for _ in fps:
        for d in fps:
            least[d] = min(least[e] for e in fps if (fps[d] ^ fps[e]).bit_count() <= 4)
    assert three.columns == COLUMNS and get(three) == {d: t for d, t in want.items() if least[d] == d}
    assert {40, 41} & set(get(three)) == set()

    four = stages["PII"](spark, three, str(tmp_path))
    clean = get(four)
    assert four.columns == COLUMNS and {d for d, t in clean.items() if t != want[d]} == {46}
    assert "jane.doe" not in clean[46] and "555-4510" not in clean[46] and "write to " in clean[46]

    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = cp.run(spark, str(tmp_path)).collect()
    sizes = Counter()
    for r in got:
        sizes[r.doc_id] += r.length
    assert sizes == {d: len(hf.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}
    room = Counter()
    for r in got:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 1024


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def plain_similarity(a, b, width=5):
    sets = []
    for t in (a, b):
        w = lower(t or "").split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_near_copies_of_many_bits(spark, tmp_path):
    """Copies with changed words: 0.8 of their shingles are equal, but not their fingerprints."""
    rnd = random.Random(5)
    docs, far = {}, 0
    for k in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(40, 200))]
        docs[2 * k] = " ".join(words)
        for _ in range(max(1, len(words) // (60 if k % 3 else 25))):
            words[rnd.randrange(len(words))] = "other"
        docs[2 * k + 1] = " ".join(words)
    docs[200], docs[201] = "", None
    near = {(a, a + 1) for a in range(0, 120, 2) if plain_similarity(docs[a], docs[a + 1]) >= 0.8}
    far = sum((plain_simhash(docs[a]) ^ plain_simhash(docs[b])).bit_count() > 4 for a, b in near)
    assert 20 < len(near) < 60 and far > 10
    rows = [(k, t, "en", "a", None, "extra") for k, t in docs.items()]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    kept = {r.doc_id for r in dict(cp.STAGES)["SimHash near-dedup"](spark, table, str(tmp_path)).collect()}
    assert kept == set(docs) - {b for _, b in near} - {201}


def test_near_copies_in_blocks(spark):
    """A chain, each alike to the next only: blocks and sides lose no link."""
    from statloom.llm.near_copies import similar_components

    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(40)] + [(90, "of its own and quite unlike")]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(docs, "doc_id long, text string"), block=4).collect()}
    sim = {(a, b): plain_similarity(s, t) for a, s in docs for b, t in docs if a < b}
    least = {d: d for d, _ in docs}
    for _ in docs:
        for (a, b), x in sim.items():
            if x >= 0.8:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least and max(v for v in least.values()) == 90
