"""Random strings of every alphabet are found; words and identifiers are left alone."""

import random
import string

import pytest

from dagstore.llm import secrets

ALPHABETS = {
    "base32": string.ascii_uppercase + "234567",
    "lower base32": string.ascii_lowercase + "234567",
    "base36": string.ascii_lowercase + string.digits,
    "base62": string.ascii_letters + string.digits,
    "capitals": string.ascii_uppercase,
    "lower": string.ascii_lowercase,
    "letters": string.ascii_letters,
}


@pytest.fixture(scope="module")
def efficiency():
    return secrets.TokenEfficiency(*secrets.default_vocabulary())


@pytest.mark.parametrize("name", sorted(ALPHABETS))
def test_random_strings(name, efficiency):
    r = random.Random(7)
    for n in (20, 24, 32, 40):
        texts = ["".join(r.choice(ALPHABETS[name]) for _ in range(n)) for _ in range(500)]
        texts = [t for t in texts if not secrets.known(t)]
        found = sum(secrets.random_spans(f"a {t} b", efficiency) == [("random", 2, 2 + n)] for t in texts)
        assert found >= 0.96 * len(texts), (name, n, found)


def test_words_and_identifiers(efficiency):
    for s in ("internationalization-of-words", "INTERNATIONALIZATION_SETTINGS", "getUserAccountSettingsById", "max_retry_count_limit_2024", "path/to/some/other/folder/readme", "Verantwortungsbewusstsein", "invoice-20240115-00012345", "0" * 40, "x" * 5000, "-" * 60, "1234567890" * 3):
        assert secrets.random_spans(s, efficiency) == [], s
