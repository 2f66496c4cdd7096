"""Unfilled fields of any length, up to their own delimiter and the paragraph's end."""

import time

import pytest

from locusloom.llm.residue import residue

LONG = "a short description of the study site, the sowing date, the soil\nand the number of replicates, with all the dates of harvest and the names of the observers"
FIELDS = [
    "[Insert {} here]", "[TODO: {}]", "{{{{{}}}}}", "\\{{\\{{{}\\}}\\}}", "${{{}}}", "<% {} %>", "{{% {} %}}", "<?php {} ?>", "<?= {} ?>", "<insert {}>", "(fill in {})", "[hier {}]", "[{} eintragen]", "<!-- insert {} -->",
]


@pytest.mark.parametrize("field", FIELDS)
def test_long_fields(field):
    text = f"The trial was run in May. {field.format(LONG)} It ended in June."
    assert residue(text)[0] == "placeholder"
    # no field without its delimiter, quoted, in code, or over paragraphs
    assert residue(f'The form says "{field.format(LONG)}" and nothing else.') is None
    assert residue(f"The form says `{field.format(LONG)}` and nothing else.") is None
    if not field.startswith("[hier"):
        assert residue(field.format(LONG.replace("\n", "\n\n"))) is None


def test_open_delimiters_cost_no_square():
    began = time.time()
    for x in ("{{", "[", "[insert ", "(fill in ", "<% ", "<?php ", "<insert ", "{% ", "<!-- insert ", "[\n", "${"):
        residue(x * 20_000)
        residue(x + "word, " * 40_000)
        residue(x + "word,\n" * 40_000)
    assert time.time() - began < 60
