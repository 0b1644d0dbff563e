"""Spans and contexts of any length, and columns that share names with helpers."""

from loamstone.llm import pii


def test_no_length_is_limited(spark):
    name, host = "n" * 300, ".".join(["part" + "x" * 100] * 9)
    person = "Dr. A" + "b" * 200 + " C" + "d" * 200
    text = f"mail {name}(at){host} and {person}. SSN" + " " * 200 + "123-45-6789, also x (at) y (dot) com. Next one"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    held = pii.candidates(docs).first()
    spans = {z.kind: text[z.start : z.end] for z in held.more}
    assert spans["person"] == person and spans["national"] == "123-45-6789"
    assert [text[z.start : z.end] for z in held.more if z.kind == "address"] == [f"{name}(at){host}", "x (at) y (dot) com"]
    assert [z.context for z in held.more if z.kind == "national"] == [1]


def test_columns_of_helpers_pass_through(spark):
    names = ["__text", "__base", "__more", "__m_email", "__g_ip", "__s_card", "__base_spans", "__more_spans", "spans"]
    docs = spark.createDataFrame([(1, "write to a.b@c.org now", *(f"v{k}" for k in range(len(names))))], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    want = {c: f"v{k}" for k, c in enumerate(names)}
    for made in (pii.find(docs), pii.redact(docs)):
        row = made.first().asDict()
        assert {c: row[c] for c in names} == want
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).first().text == "write to [EMAIL] now"
    assert pii.find(docs, keep_text=False).columns == [c for c in docs.columns if c != "text"] + ["base_spans", "more_spans"]
