"""Answers that are asked for once, whoever asks: a table by content key with claims.

A session that lacks answers claims their keys: it writes the keys to a folder of
its own and renames that to the next free number. A rename onto a folder that is
there fails, so numbers are given out one by one, and of several claims to a key
the lowest has it. The owner publishes its answers under its number, again by a
rename; the others wait for them. A claim whose answers don't come is given up by
publishing nothing under its number, which the late owner then can't: a key has
one answer, from one reading, unless a reader died over it.
"""

from __future__ import annotations

import os
import time
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .settle import settle


class AnswerCache:
    """patience: seconds after which an owner that published nothing is taken for dead; poll: seconds between looks."""

    def __init__(self, spark: SparkSession, path: str, patience: float = 3600.0, poll: float = 0.2):
        self.spark, self.path, self.patience, self.poll = spark, path.rstrip("/"), patience, poll
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    # -- folders

    def _fs(self):
        return self.hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        folder = self.hadoop.Path(f"{self.path}/{kind}")
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _whole(self, kind: str, name: str) -> bool:
        return self._fs().exists(self.hadoop.Path(f"{self.path}/{kind}/{name}/_SUCCESS"))

    def _publish(self, staged: str, kind: str, name: str) -> bool:
        """Rename a folder to its place; False if something is there already."""
        self._fs().mkdirs(self.hadoop.Path(f"{self.path}/{kind}"))
        target = f"{self.path}/{kind}/{name}"
        if urllib.parse.urlparse(target).scheme in ("", "file"):
            try:
                os.rename(urllib.parse.urlparse(staged).path, urllib.parse.urlparse(target).path)
            except OSError:
                if os.path.exists(urllib.parse.urlparse(target).path):
                    return False
                raise
            return True
        place = self.hadoop.Path(target)
        context = self.hadoop.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.hadoop.Path(staged), place, none)
        except Exception:
            if self._fs().exists(place):
                return False
            raise
        return True

    def _staged(self, df: DataFrame | None = None) -> str:
        path = f"{self.path}/staging/{uuid.uuid4().hex}"
        if df is None:
            self._fs().create(self.hadoop.Path(f"{path}/_gone"), True).close()
        else:
            df.write.parquet(path)
        return path

    # -- the table

    def _folders(self) -> list[str]:
        """Folders that together hold each answer once: the last compact one and what was published after it."""
        compact = [c for c in self._names("compact") if self._whole("compact", c)]
        least = compact[-1] if compact else ""
        out = [f"{self.path}/compact/{least}"] if compact else []
        return out + [f"{self.path}/answers/{n}" for n in self._names("answers") if n > least and self._whole("answers", n)]

    def rows(self, like: DataFrame) -> DataFrame:
        """What the cache holds, with the columns of like."""
        folders = self._folders()
        return self.spark.read.schema(like.schema).parquet(*folders) if folders else like.limit(0)

    def answers(self, keyed: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """keyed (key and what the reader needs) with the answers; read, which gives key and answer, runs on what nobody has or reads.

        Keys that repeat are read once. If read fails, its claim is given up and the error goes on.
        """
        blank = read(keyed.limit(0))
        wanted = settle(keyed.dropDuplicates(["key"]))
        while True:
            missing = settle(wanted.join(self.rows(blank).select("key"), "key", "left_anti"))
            if missing.isEmpty():
                return keyed.join(self.rows(blank), "key")
            number, owners = self._claim(missing.select("key"))
            own = missing.join(owners.where(F.col("owner") == number).select("key"), "key", "left_semi")
            # an answer that came between the look and the claim is there by now
            own = own.join(self.rows(blank).select("key"), "key", "left_anti")
            try:
                self._publish(self._staged(read(own)), "answers", number)
            except BaseException:
                self._publish(self._staged(), "answers", number)
                raise
            self._wait([r["owner"] for r in owners.where(F.col("owner") < number).select("owner").distinct().collect()])

    def _claim(self, keys: DataFrame) -> tuple[str, DataFrame]:
        """Claim keys; the claim's number, and key and owner (the lowest live claim) of each."""
        staged = self._staged(keys)
        number = (int(self._names("claims")[-1]) if self._names("claims") else 0) + 1
        while not self._publish(staged, "claims", f"{number:012d}"):
            number += 1
        name = f"{number:012d}"
        settled = set(self._names("answers"))  # their keys were looked up, or given up
        open_ = [n for n in self._names("claims") if n <= name and n not in settled]
        every = None
        for n in open_:
            part = self.spark.read.schema(keys.schema).parquet(f"{self.path}/claims/{n}").withColumn("owner", F.lit(n))
            every = part if every is None else every.unionByName(part)
        mine = self.spark.read.schema(keys.schema).parquet(f"{self.path}/claims/{name}")
        return name, settle(every.join(mine, "key", "left_semi").groupBy("key").agg(F.min("owner").alias("owner")))

    def _wait(self, owners: list[str]) -> None:
        """Until all owners have published; those that take too long are given up."""
        began = time.time()
        while owners := [n for n in owners if n not in set(self._names("answers"))]:
            if time.time() - began > self.patience:
                for n in owners:
                    self._publish(self._staged(), "answers", n)
            else:
                time.sleep(self.poll)

    def compact(self) -> int:
        """Write all answers up to the last number below which nothing is open as one table; returns how many folders it replaces.

        Claims and answers of lower numbers go, but for the tables of the last
        compaction, which searches that began before may still read.
        """
        answers, claims = set(self._names("answers")), self._names("claims")
        done = []
        for n in claims:
            if n not in answers:
                break
            done.append(n)
        whole = [n for n in done if self._whole("answers", n)]
        before = [c for c in self._names("compact") if self._whole("compact", c)]
        fresh = [n for n in whole if not before or n > before[-1]]
        if not fresh:
            return 0
        folders = [f"{self.path}/answers/{n}" for n in fresh] + ([f"{self.path}/compact/{before[-1]}"] if before else [])
        table = self.spark.read.parquet(*folders)
        if self._publish(self._staged(table.repartition(max(1, len(fresh) // 8))), "compact", done[-1]):
            fs = self._fs()
            for n in before[:-1]:
                fs.delete(self.hadoop.Path(f"{self.path}/compact/{n}"), True)
            for n in done:
                if before and n <= before[-1]:
                    fs.delete(self.hadoop.Path(f"{self.path}/claims/{n}"), True)
                    fs.delete(self.hadoop.Path(f"{self.path}/answers/{n}"), True)
        return len(fresh)
