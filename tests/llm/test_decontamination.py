import random

from perilake.llm.decontamination import SegmentIndex, aligned_end, find_in_block, find_passages, normal, without_passages

WORDS = [f"{a}{b}{c}" for a in ("tra", "mo", "shel", "in", "qua") for b in ("ver", "lin", "do", "ska") for c in ("t", "ne", "m", "rio")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            out.insert(at, rng.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


def infix_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_same_as_brute_force():
    rng = random.Random(5)
    items = [(i, normal(prose(rng, n))) for i, n in enumerate((6, 12, 20, 40, 7))]
    index = SegmentIndex(items, 80, 0.06)
    texts = []
    for n in range(60):
        item = items[rng.randrange(len(items))][1].decode()
        cut = item[rng.randrange(0, max(1, len(item) - 80)) :]
        texts.append(normal(prose(rng, 15) + " " + edited(rng, cut, rng.randrange(0, 9)) + " " + prose(rng, 15)))
    texts += [b"", b"a", items[3][1], items[3][1][:79]]
    for text, found in zip(texts, find_in_block(index, texts), strict=True):
        want = {item for item, piece, k in index.segments if infix_distance(piece, text) <= k}
        assert {item for item, _, _ in found} == want


def test_alignment_at_the_edges():
    assert aligned_end(b"abcdefghij", b"abcdefghij", -2, 2, 1) == 10
    assert aligned_end(b"abcdefghij", b"bcdefghij", -2, 2, 1) >= 0
    assert aligned_end(b"abcdefghij", b"cdefghij", -2, 2, 1) == -1
    assert aligned_end(b"abcdefghij", b"xxabcdefghixj", 0, 4, 1) in (11, 12, 13)


def test_whole_table(spark):
    rng = random.Random(9)
    items = [prose(rng, 25) for _ in range(30)]
    rows = [(i, prose(rng, 60), 0) for i in range(40)]
    leaks = {100 + i: prose(rng, 20) + "\n" + t.upper().replace(" ", "  ") + "\n" + prose(rng, 20) for i, t in enumerate(items)}
    rows += [(i, t, 0) for i, t in leaks.items()] + [(500, None, 0), (501, "", 0), (502, prose(rng, 30_000) + items[0], 0), (100, leaks[100], 0), (None, items[1], 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "the of"), (0, items[0])], "item_id long, text string")
    found = find_passages(documents, benchmark).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted([*leaks, 100, 502, None], key=str)
    assert all(r.items == str(r.doc_id - 100) for r in found if r.doc_id in leaks)
    blocks = find_passages(documents, benchmark, block_bytes=1500).collect()
    assert {(r.doc_id, r.items) for r in blocks} == {(r.doc_id, r.items) for r in found}
    kept = without_passages(documents, benchmark)
    assert kept.columns == documents.columns and kept.count() == 42
    assert find_passages(documents.limit(0), benchmark).collect() == [] and find_passages(documents, benchmark.limit(0)).collect() == []


def test_rows_without_an_id_or_sharing_one_and_items_without_one(spark):
    rng = random.Random(12)
    items = [prose(rng, 25) for _ in range(8)]
    clean = [prose(rng, 60) for _ in range(2)]
    dirty = [prose(rng, 20) + " " + items[0] + " " + prose(rng, 20) + " " + items[1], prose(rng, 9) + " " + items[2]]
    rows = [(None, clean[0]), (None, dirty[0]), (5, clean[1]), (5, dirty[1]), (5, dirty[1])]
    documents = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    benchmark = spark.createDataFrame([(None, items[0]), (None, items[3]), *[(i, t) for i, t in enumerate(items) if i]], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in without_passages(documents, benchmark).collect()) == sorted([(0, clean[0]), (5, clean[1])])
    assert sorted((r.doc_id or 0, r.text) for r in without_passages(documents, benchmark, block_bytes=300).collect()) == sorted([(0, clean[0]), (5, clean[1])])
    one, many = (sorted(map(tuple, find_passages(documents, benchmark, block_bytes=size).collect()), key=str) for size in (4 << 20, 300))
    assert one == many and len(one) == 3
    assert {(r[0], r[2]) for r in one} == {(None, "1,null"), (5, "2")}
