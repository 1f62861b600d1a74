"""Orders as applicants and their line items as family members: profiles over the driver's tables, and rule sets for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions.values import DDL, of_bool, of_num, of_str
from verdictlake.plans.rulesets import Exclusion, Leaf, Node, RuleSet

FACTS = f"MAP<STRING, {DDL}>"
MEMBER = f"STRUCT<ix: INT, facts: {FACTS}>"

_TREE = Node("and", (Leaf("total_price", ">=", 50000, "economic"), Node("or", (Leaf("priority", "in", ["1-URGENT", "2-HIGH"], "institutional"), Leaf("status", "==", "F", "institutional")))))
_X1 = Exclusion("returned", "==", True, "economic", "some_family_member", exception=Leaf("discount", ">=", 0.09))
_X2 = Exclusion("quantity", ">=", 45, "family_unit", "count_family_members", ">=", 2, Leaf("total_price", ">=", 300000), "applicant")
_X3 = Exclusion("tax", ">", 0.06, "economic", "all_family_members")

H1 = RuleSet("H1", _TREE, (_X1, _X2, _X3), requirements=("photo identity",))
#: A draft of H1 with an operator flipped, an exclusion dropped and a threshold raised by half.
H2 = RuleSet("H2", Node("and", (_TREE.children[0], Node("or", (_TREE.children[1].children[0], Leaf("status", "!=", "F", "institutional"))))), (_X1, Exclusion("quantity", ">=", 45, "family_unit", "count_family_members", ">=", 2, Leaf("total_price", ">=", 450000), "applicant")))
#: Another draft: H1 without its second exclusion.
H3 = RuleSet("H3", _TREE, (_X1, _X3))


def _facts(pairs: dict) -> Column:
    """A map of the facts whose condition holds: absent facts have no key. A condition of None always holds.

    There is one map for each set of conditions that can hold, so that a row builds the one map it needs.
    """
    free = [name for name, (present, _) in pairs.items() if present is not None]
    made = None
    for held in range(1 << len(free)):
        gone = {name for i, name in enumerate(free) if not held >> i & 1}
        one = F.create_map(*[x for name, (_, value) in pairs.items() if name not in gone for x in (F.lit(name), value)])
        there = reduce(lambda a, b: a & b, [pairs[name][0] for name in free if name not in gone], F.lit(True))
        made = one if made is None else F.when(there, one).otherwise(made)
    return made


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile_id, members for every order, with or without line items."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    known = lambda c: F.coalesce(c, F.lit(False))
    # one exchange on the order's key holds orders and lines together; a broadcast of either would leave its scan's few tasks.
    # Plain columns travel, facts are built of them behind it.
    own = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    line = F.struct(
        F.col("l_linenumber").alias("ix"), (F.col("l_returnflag") == "R").alias("returned"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"),
        known(F.col("l_partkey") % 13 != 0).alias("has_returned"), known(F.col("l_suppkey") % 17 != 0).alias("has_quantity"),
    )
    own = orders.select(F.col("o_orderkey").alias("profile_id"), own.alias("own"))
    family = lines.select(F.col("l_orderkey").alias("profile_id"), line.alias("line"))
    together = own.unionByName(family, allowMissingColumns=True).groupBy("profile_id").agg(F.any_value("own", True).alias("own"), F.collect_list("line").alias("lines")).where("own IS NOT NULL")
    me = _facts({
        "total_price": (None, of_num(F.col("own.price"))),
        "priority": (known(F.col("profile_id") % 7 != 0), of_str(F.col("own.priority"))),
        "status": (None, of_str(F.col("own.status"))),
        "returned": (None, of_bool(F.lit(False))),
        "discount": (known(F.col("profile_id") % 11 != 0), of_num(F.lit(0.0))),
        "quantity": (None, of_num(F.lit(0.0))),
        "tax": (None, of_num(F.lit(1.0))),
    })
    member = lambda m: F.struct(m["ix"].alias("ix"), _facts({
        "returned": (m["has_returned"], of_bool(m["returned"])),
        "discount": (None, of_num(m["discount"])),
        "quantity": (m["has_quantity"], of_num(m["quantity"])),
        "tax": (None, of_num(m["tax"])),
    }).alias("facts"))
    return together.select("profile_id", F.concat(F.array(F.struct(F.lit(0).alias("ix"), me.alias("facts"))), F.transform("lines", member)).alias("members"))
