"""The prefix tree of a model as a table, and as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.config import MinerConfig
from logloom.functions import tokens

from .kernel import Rules, Tree

SCHEMA = "root_key string, rank long, path array<string>, cluster_ids array<long>"


def _loaded(pdf: pd.DataFrame, rules: Rules) -> Tree:
    tree = Tree(rules)
    for row in pdf.sort_values("cluster_id").itertuples():
        tree.load(int(row.cluster_id), tuple(row.template_tokens), int(row.size))
    return tree


def _keyed(model: DataFrame, config: MinerConfig) -> DataFrame:
    key = tokens.root_key(F.col("template_tokens"), config.engine, config.param_binning)
    return model.select("cluster_id", "template_tokens", "size", key.alias("key")).groupBy("key")


def nodes(model: DataFrame, config: MinerConfig | None = None) -> DataFrame:
    """Nodes that hold clusters: root_key, rank (depth-first within the root), path, cluster_ids.

    Each root's clusters are put back in order of id, which is how a stored
    model is loaded; roots are independent tasks.
    """
    config = config or MinerConfig()
    rules = Rules.of(config)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []

        def walk(key: str, node, path: list[str]) -> None:
            if node.ids:
                out.append((key, len(out), path, list(node.ids)))
            for token, child in node.children.items():
                walk(key, child, [*path, token])

        for key, root in _loaded(pdf, rules).roots.items():
            walk(key, root, [])
        return pd.DataFrame(out, columns=["root_key", "rank", "path", "cluster_ids"])

    return _keyed(model, config).applyInPandas(table, SCHEMA)


def rendered(model: DataFrame, config: MinerConfig | None = None, most: int = 5) -> DataFrame:
    """(root_key, text): the indented tree of each root with up to ``most`` clusters a node."""
    config = config or MinerConfig()
    rules = Rules.of(config)

    def text(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = _loaded(pdf, rules)
        return pd.DataFrame([(next(iter(tree.roots)), tree.render(most))], columns=["root_key", "text"])

    return _keyed(model, config).applyInPandas(text, "root_key string, text string")
