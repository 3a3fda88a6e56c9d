"""The walk over variants against the walk over Python values, on random trees."""

import json
import random

from pyspark.sql import functions as F

from larder.operators.jsonld import find_recipe
from larder.operators.variants import find_recipes


def test_variants_as_python_walks(spark):
    rng = random.Random(3)

    def tree(depth):
        if not depth or rng.random() < 0.25:
            return rng.choice(["a", "", None, 0, 1, -2.5, 0.0, True, False, [], {}, "Recipe", "0", "false"])
        if rng.random() < 0.4:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["@graph", "@type", "x", "y", "z"] if rng.random() < 0.93 else ["recipeIngredient", "cookTime", "prepTime"]): rng.choice([tree(depth - 1), "Recipe", ["Thing", "reCipe"]] if rng.random() < 0.1 else [tree(depth - 1)]) for _ in range(rng.randint(0, 4))}

    def shown(text):
        """JSON with sorted keys, whole floats as integers."""
        return json.dumps(json.loads(text, parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x)), sort_keys=True)

    trees = [tree(6) for _ in range(400)]
    given = [(i, json.dumps(v)) for i, v in enumerate(trees)] + [(1000, None), (1001, ""), (1002, "{"), (1003, "[" * 5000), (1004, '"Recipe"'), (None, '{"cookTime":1}'), (1005, '{"cookTime":"x"}'), (1005, '[{"cookTime":"y"}]')]
    frame = spark.createDataFrame([(*g, "v", 3) for g in given], "id long, raw string, v string, row int")
    got = sorted((str(r["id"]), shown(r["j"])) for r in find_recipes(frame).select("id", F.to_json("recipe").alias("j")).collect())
    want = [(str(i), find_recipe(json.loads(json.dumps(v, sort_keys=True)))) for i, v in enumerate(trees)] + [("None", {"cookTime": 1}), ("1005", {"cookTime": "x"}), ("1005", {"cookTime": "y"})]
    want = sorted((i, shown(json.dumps(v))) for i, v in want if v is not None)
    assert len(want) > 60 and got == want
    assert find_recipes(frame.limit(0)).count() == 0
    assert "Python" not in find_recipes(frame)._jdf.queryExecution().executedPlan().toString()


def test_levels_share_rounds_and_parsing(spark, monkeypatch):
    from larder.operators import variants

    written = []
    keep = variants.shared_table

    def counted(df, name):
        written.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(variants, "shared_table", counted)
    given = [(n, "[" * n + '{"prepTime":1,"name":"x"},{"cookTime":2}' + "]" * n) for n in range(1, 14)]
    found = find_recipes(spark.createDataFrame(given, "id long, raw string"))
    assert sorted(r["id"] for r in found.filter(F.variant_get("recipe", "$.name", "string") == "x").collect()) == list(range(1, 14)) and found.count() == 13
    assert len(written) <= 14 / variants.LEVELS + 2 and written[0].count("parse_json") <= 1
