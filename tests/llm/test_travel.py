"""Task functions reach executors by value: these need no copy of the package."""

import base64
import pickle
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from dialoom.llm import (
    decontamination,
    html_main,
    html_tree,
    language_id,
    linking,
    near_dedup,
    ngram_join,
    prefix_trie,
    shingles,
    token_output,
    whitening,
)
from dialoom.operators import inference, ordering, pyscripts, scripts
from dialoom.sources import scripts as sources
from dialoom.sources import writers

MODULES = [
    decontamination, html_main, html_tree, language_id, linking, near_dedup, ngram_join, prefix_trie, shingles, token_output, whitening,
    inference, ordering, pyscripts, scripts, sources, writers,
]


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__)
def test_functions_and_classes_load_without_the_package(module, tmp_path):
    own = [v for v in vars(module).values() if getattr(v, "__module__", None) == module.__name__ and (callable(v) or isinstance(v, type))]
    assert own
    code = (
        "import base64, pickle, sys\n"
        "try:\n    import dialoom\n    sys.exit('the package is there')\nexcept ImportError:\n    pass\n"
        "for line in sys.stdin:\n    pickle.loads(base64.b64decode(line))\n"
    )
    lines = "\n".join(base64.b64encode(cloudpickle.dumps(v)).decode() for v in own)
    done = subprocess.run([sys.executable, "-c", code], input=lines, text=True, capture_output=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_letters_are_found_without_the_package(tmp_path):
    code = "import base64, pickle, sys\nf = pickle.loads(base64.b64decode(sys.stdin.read()))\nprint(f('Ab 1é').tolist(), f('1'))"
    given = base64.b64encode(cloudpickle.dumps(language_id.letters_of)).decode()
    done = subprocess.run([sys.executable, "-c", code], input=given, text=True, capture_output=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
    assert done.stdout.strip() == f"{language_id.letters_of('Ab 1é').tolist()} None", done.stderr[-2000:]


def test_broadcasts_hold_plain_values(spark, sf, monkeypatch):
    """Spark pickles what is broadcast by name, so no class of the package may be in it."""
    sent = []
    real = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), real(value))[1])
    language_id.digest(spark.read.parquet(f"{sf}/documents.parquet")).count()
    whitening.digest(spark.read.parquet(f"{sf}/embeddings.parquet")).count()
    sent = [value for value in sent if not isinstance(value, bytes)]  # Spark's own: long functions, by value
    assert len(sent) >= 3
    assert all(b"dialoom" not in pickle.dumps(value) for value in sent)
