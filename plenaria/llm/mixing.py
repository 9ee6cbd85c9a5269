"""Problem 9: sources combined to target weights of the total tokens, each repeated a capped number of times.

Budgets are set on a tree: domains, their languages, the sources in a language. A source's weight is spread over its
languages by its own tokens, a node weighs what its sources weigh. Budgets go down from the root by weight; what a node's
leaves can't give goes to its siblings first (the other sources of the same language and domain), then to its parent's (the
domain's other languages), then to other domains. Each leaf's budget is spent in seeded epochs: whole passes over the leaf,
then the token prefix of one more pass in that pass's own hash order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.functions.ranks import hash_prefix, unit_hash
from plenaria.llm.tokens import VOCABULARY, count_column
from plenaria.runtime import cut, table

SEED = "plenaria-mix-1"
ROOT = "all"
#: The domain of sources for which none is given.
DOMAIN = "parliament"
#: Tokens by which a budget may miss its target and still reach it, against rounding.
ROUNDING = 1e-6
REPORT = "source string, target_share double, available_tokens bigint, max_repeats int, target_tokens double, budget_tokens double, short boolean"


@dataclass
class Node:
    """A node with its weight among its siblings; a leaf has the tokens it can give, repeats included, and the repeats."""

    name: str
    weight: float
    limit: float = 0.0
    repeats: int = field(default=0, kw_only=True)
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children) if self.children else self.limit


def fill(node: Node, budget: float) -> float:
    """Spread a budget over the tree; returns what the node couldn't take.

    Among the children the budget goes by weight; what one can't take goes to its siblings that still can, by weight again,
    before anything is returned to the parent, which does the same one level up.
    """
    node.budget = min(budget, node.capacity())
    if node.children:
        open_, left = list(node.children), node.budget
        shares = dict.fromkeys(map(id, node.children), 0.0)
        while open_ and left > 1e-9:
            total = sum(c.weight for c in open_)
            part = {id(c): left * (c.weight / total if total else 1 / len(open_)) for c in open_}
            full = [c for c in open_ if shares[id(c)] + part[id(c)] >= c.capacity()]
            for c in full or open_:
                take = min(part[id(c)], c.capacity() - shares[id(c)])
                shares[id(c)] += take
                left -= take
            if not full:
                break
            open_ = [c for c in open_ if c not in full]
        for c in node.children:
            fill(c, shares[id(c)])
    return budget - node.budget


def source_name(column: str = "source"):
    """Sources compare without letter case and outer blanks."""
    return F.lower(F.trim(F.col(column)))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang (two letters, 'und' if unknown) and tokens of all documents that have a source, written once."""
    lang = F.lower(F.substring(F.trim(F.coalesce(F.col("lang"), F.lit("und"))), 1, 2))
    kept = documents.select("doc_id", source_name().alias("source"), F.when(lang == "un", "und").otherwise(lang).alias("lang"), "text")
    kept = kept.where(F.col("source").isNotNull() & (F.col("source") != ""))
    return cut(count_column(kept, "text", "tokens", vocabulary))


def tree(sums: dict[tuple[str, str], int], wanted: dict[str, tuple[float, int]], domains: dict[str, str]) -> Node:
    """The tree of domains, languages and sources. sums: tokens by (source, lang); wanted: weight and repeats by source;
    domains: the domain of a source, all others are of one."""
    root = Node(ROOT, 0.0)
    for source, (weight, repeats) in sorted(wanted.items()):
        own = {lang: n for (s, lang), n in sorted(sums.items()) if s == source} or {"und": 0}
        whole = sum(own.values())
        for lang, n in own.items():
            path = root
            for name in (domains.get(source, DOMAIN), lang):
                found = next((c for c in path.children if c.name == name), None)
                if found is None:
                    path.children.append(found := Node(name, 0.0))
                path = found
            path.children.append(Node(source, weight * n / whole if whole else weight / len(own), n * repeats, repeats=repeats))

    def weigh(node: Node) -> float:
        node.weight = sum(map(weigh, node.children)) if node.children else node.weight
        return node.weight

    weigh(root)
    return root


def leaves(root: Node) -> dict[tuple[str, str], Node]:
    """The leaves by source and language."""
    return {(leaf.name, lang.name): leaf for domain in root.children for lang in domain.children for leaf in lang.children}


def plan(sizes: DataFrame, targets: DataFrame, domains: dict[str, str] | None = None) -> tuple[Node, list[tuple], dict[tuple[str, str], float]]:
    """The filled tree, the report rows and the tokens of each leaf. The driver gets one sum per source and language."""
    sums = {(r.source, r.lang): r.n for r in sizes.groupBy("source", "lang").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(sums.values())
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(source_name().alias("source"), "weight", "max_repeats").where("source IS NOT NULL").collect():
        weight, repeats = wanted.get(r.source, (0.0, 0))
        wanted[r.source] = (weight + (r.weight or 0.0), max(repeats, r.max_repeats or 0))
    root = tree(sums, wanted, domains or {})
    fill(root, float(total))
    budgets = dict.fromkeys(wanted, 0.0)
    for (source, _), leaf in leaves(root).items():
        budgets[source] += leaf.budget
    rows = []
    for source, (weight, repeats) in sorted(wanted.items()):
        own = sum(n for (s, _), n in sums.items() if s == source)
        # a leaf gets its target before anything is handed on, so a budget under the target means that there is no more
        rows.append((source, weight, own, repeats, weight * total, budgets[source], budgets[source] < weight * total - ROUNDING))
    return root, rows, {k: float(v) for k, v in sums.items()}


def mix_report(sizes: DataFrame, targets: DataFrame, domains: dict[str, str] | None = None) -> DataFrame:
    """One row per wanted source; short: it can't reach its weight even when repeated max_repeats times.

    A source without documents has 0 tokens and is short unless its weight is 0. Sources named twice add their weights.
    Without documents nothing is short, as the total is 0. Weights of more than 1 in all can't be reached by all: then every
    source that gets less than its weight is short.
    """
    return sizes.sparkSession.createDataFrame(plan(sizes, targets, domains)[1], REPORT)


def mix(sizes: DataFrame, targets: DataFrame, seed: str = SEED, domains: dict[str, str] | None = None) -> DataFrame:
    """One row per document of the mix: doc_id, source, lang, tokens, copies.

    A leaf's whole epochs take every document; the rest of its budget is the longest prefix, in the hash order of that
    epoch, whose tokens fit. The repeats never pass max_repeats. Documents of other sources aren't taken.
    """
    root, _, sums = plan(sizes, targets, domains)
    spent = []
    for (source, lang), leaf in leaves(root).items():
        own = sums.get((source, lang), 0.0)
        epochs = int((leaf.budget + ROUNDING) // own) if own else 0
        # a leaf with all its repeats has no part of an epoch left, not even for documents without tokens
        rest = max(0.0, float(leaf.budget - epochs * own)) + ROUNDING if epochs < leaf.repeats else -1.0
        spent.append((source, lang, epochs, rest))
    budgets = sizes.sparkSession.createDataFrame(spent, "source string, lang string, _epochs int, _rest double")
    rows = sizes.join(F.broadcast(budgets), ["source", "lang"]).withColumn("_unit", unit_hash(seed, F.col("_epochs"), F.col("doc_id")))
    extra = hash_prefix(rows, ["source", "lang"], "_unit", F.col("tokens"), "_rest", "doc_id").withColumn("copies", F.lit(1))
    whole = rows.where("_epochs > 0").withColumn("copies", F.col("_epochs"))
    both = whole.select("doc_id", "source", "lang", "tokens", "copies").unionByName(extra.select("doc_id", "source", "lang", "tokens", "copies"))
    return both.groupBy("doc_id", "source", "lang", "tokens").agg(F.sum("copies").cast("int").alias("copies"))


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The actual share of the mix's tokens of each wanted source beside the wanted one."""
    sums = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    wanted = targets.groupBy(source_name().alias("source")).agg(F.sum("weight").alias("target_share"))
    joined = wanted.join(F.broadcast(sums), "source", "left").fillna(0, ["mixed_tokens"])
    return joined.join(F.broadcast(sums.agg(F.sum("mixed_tokens").alias("_all")))).select(
        "source", "target_share", "mixed_tokens", F.coalesce(F.try_divide("mixed_tokens", "_all"), F.lit(0.0)).alias("actual_share")
    )


def p9_found(spark, sf_dir):
    report = mix_report(sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))
    return report.where("short").select("source")


def p9_mix(spark, sf_dir):
    return mix(sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark, sf_dir):
    targets = table(spark, sf_dir, "mix_targets")
    return mix_shares(mix(sized(table(spark, sf_dir, "documents")), targets), targets)
