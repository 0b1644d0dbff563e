"""Near-duplicates where ids repeat: each row by its own text, one row of each group."""

from loamstone.llm import minhash

COPY = " ".join(f"w{k}" for k in range(60))
OWN = " ".join(f"x{k}" for k in range(60))
OTHER = " ".join(f"y{k}" for k in range(60))


def test_repeated_ids_are_judged_by_their_own_text(spark):
    # 5 has a near copy of 1 and a text of its own; 7 repeats literally; 8's texts have copies in different groups.
    rows = [(1, COPY), (5, COPY + " more"), (5, OWN), (7, OTHER), (7, OTHER), (8, OWN + " end"), (8, OTHER + " end"), (9, ""), (9, ""), (None, COPY), (None, COPY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted((r.doc_id or 0, r.text) for r in minhash.keep_one(docs).collect())
    assert kept == sorted([(1, COPY), (5, OWN), (7, OTHER), (9, ""), (9, ""), (0, COPY), (0, COPY)])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted([(1, 56, 1, True), (5, 57, 1, False), (5, 56, 5, True), (7, 56, 7, True), (7, 56, 7, False), (8, 57, 5, False), (8, 57, 7, False), (9, 0, 9, True), (9, 0, 9, True), (0, 56, 0, True), (0, 56, 0, True)])
