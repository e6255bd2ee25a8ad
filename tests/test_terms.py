"""Parts of the terms of a document."""

from lexivec.operators import sections

HEAD = "Buyer Added Bid Specific Terms and Conditions"


def test_parts_after_characters_of_two_units(spark):
    """Marks are found by characters, also behind some that Java counts as two, and disclaimers before the heading don't count."""
    texts = ["\U0001f600" * 9 + f" Disclaimer no. {HEAD} pay soon. Disclaimer be fair. Thank You", f"x {HEAD.upper()} pay", "Disclaimer alone. thank you", "none", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, md string")
    got = {r.k: (r.generic, r.disclaimer) for r in sections.terms(rows).collect()}
    assert got == {0: (f"{HEAD} pay soon.", "be fair."), 1: (f"{HEAD.upper()} pay", ""), 2: ("", "alone."), 3: ("", ""), 4: ("", ""), 5: ("", "")}
