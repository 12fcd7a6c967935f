"""Duplicates hidden by formatting differences, by bottom-up hashing of records.

Leaves are normalised to bare text.  A node's digest covers its children's:
in their order for arrays, sorted for objects, whose fields have no order.
Records group by root digest together with the normalised form itself, in which
objects are sorted the same way; so equal digests of different records, however
unlikely, stay apart, and that comparison is the structural confirmation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import bare, parse_container, scalar_text
from tallyforge.operators.skew import hot_keys, spread_join
from tallyforge.operators.stages import spread, stage


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def normal_form(text: str | None) -> tuple[bytes, str] | None:
    """(root digest, normalised form) of a text or JSON container; None if it has no letter or digit.

    Names and values are bare texts; a scalar counts as the text it is spelt with.  The form marks containers with control characters, which bare
    texts cannot contain, so it can be read back one way only.
    """
    root = parse_container(text)
    if root is None:
        form = bare(text)
        return (_digest(b"t" + form.encode("utf-8", "surrogatepass")), form) if form else None
    some = False
    done: list[tuple[bytes, str]] = []
    stack: list[tuple] = [(root, 0)]
    while stack:
        value, visit = stack.pop()
        if isinstance(value, dict):
            if not visit:
                stack.append((value, 1))
                stack.extend((child, 0) for child in value.values())
                continue
            children = done[len(done) - len(value) :] if value else []
            del done[len(done) - len(value) :]
            names = [bare(name) for name in value]
            some = some or any(names)
            # children were finished last field first
            fields = sorted((_digest(b"f" + n.encode("utf-8", "surrogatepass") + b"\x01" + d), n + "\x01" + f) for n, (d, f) in zip(names, reversed(children)))
            done.append((_digest(b"o" + b"".join(d for d, _ in fields)), "\x02" + "\x03".join(f for _, f in fields) + "\x04"))
        elif isinstance(value, list):
            if not visit:
                stack.append((value, 1))
                stack.extend((child, 0) for child in value)
                continue
            children = done[len(done) - len(value) :] if value else []
            del done[len(done) - len(value) :]
            done.append((_digest(b"a" + b"".join(d for d, _ in reversed(children))), "\x05" + "\x03".join(f for _, f in reversed(children)) + "\x06"))
        else:
            leaf = bare(scalar_text(value))
            some = some or bool(leaf)
            done.append((_digest(b"l" + leaf.encode("utf-8", "surrogatepass")), leaf))
    return done[0] if some else None


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(no, digest, form) of the rows with at least one letter or digit in their text.  Rows with a null key or text are left out."""
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("no"), F.col(text).cast("string").alias("text")).where(F.col("no").isNotNull() & F.col("text").isNotNull())

    def run(batches):
        for batch in batches:
            keep, digests, texts = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                made = normal_form(value)
                if made is not None:
                    keep.append(i)
                    digests.append(made[0])
                    texts.append(made[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(digests, pa.binary()), pa.array(texts, pa.string())], names=["no", "digest", "form"])

    return spread(source).mapInArrow(run, f"no {kind}, digest binary, form string")


def copy_groups(rows: DataFrame) -> DataFrame:
    """(digest, kept_no, copies): one row for each record that remains, with how many copies it had, itself included.

    Rows group by digest and by the whole form, so records of one group are equal in full and not only in their digest.
    """
    return rows.groupBy("digest", "form").agg(F.min("no").alias("kept_no"), F.count("*").alias("copies"))


def copy_pairs(rows: DataFrame) -> DataFrame:
    """(kept_no, copy_no): each copy but the smallest number of its group.

    Groups are counted map-side first and never gathered.  Rows then look up their group by the 128-bit digest and a 64-bit hash of
    the form, so forms are shuffled once and not again; rows of a group that holds a large part of all rows are spread over many tasks.
    """
    rows = stage(rows, "forms")
    check = F.xxhash64("form").alias("check")
    groups = stage(copy_groups(rows).where("copies > 1").select("digest", check, "kept_no", "copies"), "groups")
    hot = hot_keys(groups, ["digest", "check"], "copies")
    found = spread_join(rows.select("digest", check, "no"), groups.drop("copies"), ["digest", "check"], hot, "no")
    return found.where(F.col("no") > F.col("kept_no")).select("kept_no", F.col("no").alias("copy_no"))
