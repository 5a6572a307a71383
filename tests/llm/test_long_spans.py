"""Spans longer than MAX_SPAN."""

import random

from confluo.llm import pii


def test_long_spans():
    r = random.Random(3)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    for text, secret in ((f'mail {"a" * 300}@x.example.com now token = "{{}}" end', key(40)), ('token = "{}" end', key(400)), ('api_key: "{}" end', key(3000))):
        text = text.format(secret)
        base, every = pii.spans_of(text)
        begin = text.index(secret)
        assert ("secret", begin, begin + len(secret)) in every and set(base) <= set(every)
