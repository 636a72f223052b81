"""Several notices in a line, and notices within long lines."""

import random

from factspark.llm import licenses
from test_licenses import families, filler, model  # noqa: F401


def test_two_notices_in_a_line(model):  # noqa: F811
    r = random.Random(5)
    pairs = [("MIT", "CC-BY-4.0", "Released under the MIT License. Licensed under CC BY 4.0.")]
    short = [(f, t) for f, t in licenses.TEMPLATES if len(t.split()) < 14]
    for _ in range(60):
        (f, a), (g, b) = r.sample(short, 2)
        pairs.append((f, g, f"{a} {b}"))
    assert families(model, [t for _, _, t in pairs]) == [sorted({f, g}) for f, g, _ in pairs]


def test_within_a_long_line(model, filler):  # noqa: F811
    texts = [f"{filler(400)} {t} {filler(400)}" for _, t in licenses.TEMPLATES]
    assert families(model, texts) == [[f] for f, _ in licenses.TEMPLATES]
