"""Bank accounts end where their country says, whatever follows."""

from tidemill.llm import pii

ACCOUNTS = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S", "BE68539007547034"]
BEHIND = ["", " BIC COBADEFFXXX", " EUR 20", " 12", " bank", ".", " GB82WEST12345698765432"]


def test_words_behind_an_account(spark):
    texts = [f"IBAN {a}{b}" for a in ACCOUNTS for b in BEHIND] + ["DE89370400440532013001 EUR", "DE893704004405320130001", "xDE89370400440532013000"]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"] if s["kind"] == "iban"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (a, b) in enumerate((a, b) for a in ACCOUNTS for b in BEHIND):
        want = [(5, 5 + len(a))] + ([(6 + len(a), 5 + len(a) + len(b))] if "WEST" in b else [])
        assert got[i] == want, texts[i]
    assert [got[i] for i in range(len(texts) - 3, len(texts))] == [[], [], []]
