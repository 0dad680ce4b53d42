"""Base phones whose digits lie several separators apart."""

from caminho.llm.op9_pii import find_pii

PHONES = ["+1 (212) - 555 - 1234", "+49 (030) - 123 - 4567", "+1 - 212 - 555 - 0187", "+1 ... 212 ---- 555 (((  0187"]


def test_wide_separators(spark):
    docs = spark.createDataFrame([(k, f"reach me {x} now") for k, x in enumerate(PHONES)], "doc_id long, text string")
    found = {r.doc_id: [(x.start, x.kind, x.end) for x in r.spans if x.base] for r in find_pii(docs).collect()}
    assert found == {k: [(9, 3, 9 + len(x))] for k, x in enumerate(PHONES)}
