"""Payloads with images against a recursive walk over parsed JSON."""

import json
import random

from colloquy.sources import readers as S


def holds(x):
    if isinstance(x, dict):
        kind = x.get("type")
        return (isinstance(kind, str) and kind.lower() in S.IMAGE_TYPES) or any(k in x for k in S.IMAGE_KEYS) or any(map(holds, x.values()))
    return isinstance(x, list) and any(map(holds, x))


def test_images_at_any_depth(spark, tmp_path):
    rng = random.Random(3)

    def made(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind == 0:
            return rng.choice([None, 1, True, "image", 'say "image": 1', "type"])
        if kind < 3 or not depth:
            return {rng.choice(["a", "Type", "type", "text"]): rng.choice(["text", "IMAGE", "input_image", "x", 5, None]) for _ in range(2)} if rng.random() < 0.5 else "plain"
        if kind < 5:
            return {rng.choice(["a", "b", "content", "photo" if rng.random() < 0.08 else "c"]): made(depth - 1) for _ in range(2)}
        return [made(depth - 1) for _ in range(rng.randint(0, 3))]

    texts = [json.dumps(made(rng.randint(0, 6))) for _ in range(150)] + [None, "", "{broken", '"image"', "[]", '{"photos": null}', '[[[[{"type": "Photo"}]]]]', '{"type": ["image"]}']
    n = iter(range(100))

    def stage(df):
        path = str(tmp_path / str(next(n)))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    got = {r.id: r.image for r in S.image_payloads(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", stage).collect()}

    def parsed(t):
        try:
            return json.loads(t)
        except (TypeError, ValueError):
            return None

    assert got == {k: holds(parsed(t)) for k, t in enumerate(texts)}
    assert 10 < sum(got.values()) < len(texts) - 10
