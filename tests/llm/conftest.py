import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark):
    import cases

    return cases.documents(spark).cache()


@pytest.fixture(scope="session")
def empty(spark):
    import cases

    return cases.documents(spark, [])


@pytest.fixture(scope="session")
def word_bpe():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")
