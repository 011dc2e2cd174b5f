"""op6: IBANs before a blank and a capital or digit, and in one another's runs."""

from knitwork.llm.personal_data import find_personal_data

DE, SPACED, GB, NO = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
TEXTS = [
    (f"IBAN {SPACED} BIC COBADEFFXXX", [SPACED]),
    (f"account {DE} The rent", [DE]),
    (f"{GB} Please", [GB]),
    (f"account {DE} 2024-01-01", [DE]),
    (f"é𝄞 {DE} {GB}", [DE, GB]),
    (f"{SPACED} {SPACED} {NO} A B C", [SPACED, SPACED, NO]),
    (f"DE00 {SPACED}, {NO}", [SPACED, NO]),
    (f"{DE}X {DE}x x{DE} DE89370400440532013001 {GB[:-3]}", []),
    (f"bank {NO} {DE[:-1]}", [NO]),
    ("", []),
]


def test_ibans_before_capitals_and_digits(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    for r in find_personal_data(df).collect():
        text, want = TEXTS[r.doc_id]
        assert [text[s.start : s.finish] for s in r.iban] == want, text
