"""Residue: what is found and what is left alone."""

import pytest

from locusloom.llm.residue import expand, find_residue, phrases, residue, without_residue

REAL = "The lead marker explains 12.5% of the variance, and its minor allele is carried by 17 lines."
FOUND = [
    "Dear {{name}}, your seeds were sent.", "The peak at ${pos} is gone.", "We removed [INSERT n_lines HERE] markers.", "Sow <insert count> seeds per tray.", "Score (fill in trait) on day 4.",
    "Line: ________ Site: ________", "XXXX plants were scored at XX degrees.", "A value of %p_value% was found.", "It depends on __trait_name__ alone.", "Held at [[title]] for long.", "Kept in @@site@@ for now.",
    "The {% summary %} follows.", "Rows <%= n %> of many.", "#{lead_snp} vanished.", "Near <n_lines> lines.", "Carries a [collection_year] polymorphism.", "An \\{\\{author\\}\\} effect.", "i18n:report.value plants stood there.", "Near &lt;GENE_NAME&gt; it vanished.", "A mean of {0:.2f} was found.", "Gone at {}.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Coming soon.", "Replace this text with the abstract.", "Your figure caption goes here.", "Dies ist nur Blindtext.", "Hier steht später der richtige Text.",
    "Texte de remplissage, à remplacer avant la publication.", "Texto de relleno, pendiente del contenido definitivo.", "blah blah blah", "This paragraph only fills space until the real text arrives.",
    "404 Not Found", "403 Forbidden\nYou do not have permission to open this record.", "503 SERVICE UNAVAILABLE", "Your session has expired", "Too many requests from your address, slow down.", "Seite nicht gefunden", "Accès refusé",
    "La sesión ha caducado\nInténtelo de nuevo más tarde.", "Error establishing a database connection", "The upstream server did not answer\nin time.", "Application error: a server-side exception has occurred",
    "Please enable JavaScript to view this page.", "Checking your browser before opening the archive.", "If you see this message, JavaScript files were blocked.", "Replace this block before going live.", "HTTP/1.1 503", "Loading...", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Ce site nécessite JavaScript pour fonctionner.",
    "Esta aplicación requiere JavaScript.", "Your browser is not supported, please upgrade it to see the viewer.", "Enable JS and disable any ad blocker to go on.", "The content could not be shown because active\nscripting is turned off.",
]
CLEAN = [
    REAL, 'The old page answers "404 Not Found", therefore we copied the list of 31 lines here.', "Marker 404 was not found in the second panel.", "Error bars show the standard error; error 500 in the plot is a batch number.",
    "The viewer relies on JavaScript, so we copied its 82 values to the table below.", "Set `OUT=${HOME}/scan` in the shell first.", "The report builder replaces `{{trait}}` by the trait name.", "Genotypes are coded {0, 1, 2} and the missing code is 9.",
    "Columns <chrom> and <pos> in the manual stand for chromosome and position.", "Haplotype [A/G] at 4,017,848 and <20 reads in 8 lines.", "The pair {A, B} is counted once.", "Run awk with $1 and $4 to print the columns.",
    "The [TODO] tag in a sheet tells the crew that pot 62 still has to be weighed.", "The form asks to \"enter name here\"; all 79 observers did so.", "Access denied by the landowner at Nifibus: sampling moved 717 metres.",
    "Coming soon in the shop: seeds of Har-35, 22 packets.", "An earlier draft held lorem ipsum in the caption; the caption now describes leaf roll.", "We printed sample text labels for 14 pots.", "The log line is built with '%d markers, %s' and 19 of them were checked.",
    "In May the upload failed with an internal\nserver error 9 times; the rows were sent again later.", "09:14:43 ERROR line 3072: position 33x is not a number\n09:14:50 WARN marker mk2_3: 80 missing calls", "This page lists the 16 lines for which scripts are available.",
    "The session at Drolm expired without a vote.", "Die Seite 373 im Heft wurde nicht gefunden, die Werte fehlen daher.", "x = a[i] + b[j]; f(x) % 2", "", "   \n", "----\n____________\n",
]


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    assert residue(text)
    assert residue(f"{REAL}\n\n{text}\n\n{REAL}")


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert residue(text) is None
    assert residue(f"{REAL} {text} {REAL}" if text.strip("-_\n ") else text) is None


def test_phrase_tables():
    assert expand("a (b|c|) d") == ["a b d", "a c d", "a d"] and expand("(x|(y|z) w)") == ["x", "y w", "z w"]
    assert len(phrases()) > 5000 and "" not in phrases() and not any("(" in p or "|" in p for p in phrases())


def test_tables(spark):
    rows = [(1, REAL, "x"), (2, "Loading...", "x"), (3, None, "x"), (4, "", "x"), (5, "Loading...", "x"), (6, (REAL + " ") * 3000 + "{{x}}", "x"), (7, "a" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    found = find_residue(df)
    assert {r.doc_id: r.kind for r in found.collect()} == {2: "message", 5: "message", 6: "placeholder"}
    assert {r.doc_id for r in without_residue(df, found).collect()} == {1, 3, 4, 7}
    assert find_residue(df.filter("false")).count() == 0
