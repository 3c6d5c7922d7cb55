import os
import re

from gauntlet.session import checkpoint_root

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use themselves
CLASHING = SCHEMA + ", score double, class string, n long, keys string, words string, component_id string, held_out string"


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOW) if lower else (text or ""))


def docs(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, lang]); other columns are null."""
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def kept_files(spark):
    """Scratch tables under the checkpoint folder, and shuffle files with more than the row of a total."""
    scratch = os.path.join(checkpoint_root(spark).removeprefix("file:"), "gauntlet-scratch")
    tables = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    found = [os.path.join(top, name) for d in local for top, _, names in os.walk(d) for name in names if name.startswith("shuffle_")]
    return tables, {f for f in found if f.endswith(".data") and os.path.getsize(f) > 200}
