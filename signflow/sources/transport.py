"""SAS transport files (version 5), split: one file is read by many tasks.

A file is a run of 80-byte records, so it can be cut anywhere at a multiple of
80.  The headers say where a table's rows begin and how long a row is; rows
that a cut goes through are put together again.  Numbers are IBM hexadecimal
floats and are decoded by SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 80
#: Most records of a chunk; the chunk length has to divide the file's.
CHUNK_RECORDS = 4_096
_HEADER = "HEADER RECORD*******"


@dataclass
class Variable:
    name: str
    numeric: bool
    length: int
    offset: int


def _chunks(spark: SparkSession, path: str, most: int = CHUNK_RECORDS) -> tuple[DataFrame, int]:
    """(start, bytes) of a file in chunks of whole records, and the file's length."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(conf).getFileStatus(where).getLen()
    if size % RECORD or not size:
        raise ValueError(f"{path}: {size} bytes are no whole number of records")
    n = size // RECORD
    per = max(k for k in range(1, min(most, n) + 1) if n % k == 0) * RECORD
    # Spark's input format for records of a fixed length: splits of a file begin at records; each comes with its number
    rows = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(per)})
    df = rows.map(lambda kv: (kv[0] * per, bytes(kv[1]))).toDF("start long, bytes binary")
    return df, size


def _headers(chunks: DataFrame) -> dict[int, str]:
    """(offset, text) of the header records, of which a file has a few per table."""
    at = F.explode(F.sequence(F.lit(0), F.length("bytes") - RECORD, F.lit(RECORD)))
    rows = chunks.where(F.instr(F.decode("bytes", "ISO-8859-1"), _HEADER) > 0).select("start", "bytes", at.alias("at"))
    rows = rows.select((F.col("start") + F.col("at")).alias("offset"), F.decode(F.substring("bytes", F.col("at") + 1, F.lit(RECORD)), "ISO-8859-1").alias("text"))
    return {r.offset: r.text for r in rows.where(F.startswith("text", F.lit(_HEADER))).collect()}


def _slice(chunks: DataFrame, start: int, length: int) -> bytes:
    """The bytes of a header's part of a file."""
    rows = chunks.where((F.col("start") < start + length) & (F.col("start") + F.length("bytes") > start)).orderBy("start").collect()
    whole = b"".join(bytes(r.bytes) for r in rows)
    return whole[start - rows[0].start :][:length]


def tables(chunks: DataFrame, size: int, path: str) -> dict[str, tuple[list[Variable], int, int]]:
    """name: (variables, first byte of the rows, byte after them) of a file's tables."""
    heads = sorted(_headers(chunks).items())
    if not heads or "LIBRARY HEADER" not in heads[0][1]:
        raise ValueError(f"{path} is no transport file of version 5")
    out, member, length, at_names, found = {}, "", 140, 0, []
    for offset, text in heads:
        kind = text[len(_HEADER) :].split(" ")[0]
        if kind == "MEMBER":
            length = int(text[75:78])
        elif kind == "DSCRPTR":
            member = _slice(chunks, offset + RECORD + 8, 8).decode("latin-1").strip()
        elif kind == "NAMESTR":
            count, at_names = int(text[54:58]), offset + RECORD
            raw = _slice(chunks, at_names, count * length)
            found = []
            for i in range(count):
                v = raw[i * length : (i + 1) * length]
                found.append(Variable(v[8:16].decode("latin-1").strip(), int.from_bytes(v[:2], "big") == 1, int.from_bytes(v[4:6], "big"), int.from_bytes(v[84:88], "big")))
        elif kind == "OBS":
            nxt = next((o for o, t in heads if o > offset and "MEMBER  HEADER" in t), size)
            out[member] = (found, offset + RECORD, nxt)
    return out


def ibm_float(hexed: Column, length: int) -> Column:
    """A number of ``length`` bytes, given as hex digits, as a double; a missing value is null."""
    sign_exponent = F.conv(F.substring(hexed, 1, 2), 16, 10).cast("int")
    fraction = F.conv(F.substring(hexed, 3, 2 * length - 2), 16, 10).cast("decimal(20,0)").cast("double")
    exponent = F.pmod(sign_exponent, F.lit(128)) - 64 - 2 * (length - 1)
    value = fraction * F.pow(F.lit(16.0), exponent) * F.when(sign_exponent >= 128, -1.0).otherwise(1.0)
    # missing values are a point, an underscore or a letter, and zeros
    missing = hexed.rlike(f"^(2E|5F|4[1-9A-F]|5[0-9A])0{{{2 * length - 2}}}$")
    return F.when(missing, None).otherwise(value)


def _rows(chunks: DataFrame, first: int, end: int, length: int) -> DataFrame:
    """(row, raw): the bytes of each row; a row that chunks share is put together from its parts."""
    a = F.greatest(F.col("start"), F.lit(first)) - first
    z = F.least(F.col("start") + F.length("bytes"), F.lit(end)) - first
    inside = chunks.where((F.col("start") < end) & (F.col("start") + F.length("bytes") > first)).withColumns({"a": a, "z": z})
    n = (end - first) // length
    at = inside.select("start", "bytes", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / length), F.floor((F.col("z") - 1) / length))).alias("row")).where(F.col("row") < n)
    from_ = F.greatest(F.col("row") * length, F.col("a"))
    to = F.least((F.col("row") + 1) * length, F.col("z"))
    part = at.select("row", from_.alias("from"), F.substring("bytes", (from_ + first - F.col("start") + 1).cast("int"), (to - from_).cast("int")).alias("raw"))
    whole = part.where(F.length("raw") == length).select("row", "raw")
    # only the rows at the edges of chunks are shuffled
    cut = part.where(F.length("raw") < length).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", F.hex("raw").alias("hex")))).alias("parts"))
    return whole.unionByName(cut.select("row", F.unhex(F.array_join(F.transform("parts", lambda p: p.hex), "")).alias("raw")))


def read_transport(spark: SparkSession, path: str, table: str | None = None, encoding: str = "UTF-8", chunk_records: int = CHUNK_RECORDS) -> DataFrame:
    """The rows of a transport file's table, columns by their names; without a name the file's only table.

    Numbers are doubles, missing ones null; texts lose their trailing blanks.
    Rows at the very end that are all blank are padding of the last record.
    """
    chunks, size = _chunks(spark, path, chunk_records)
    found = tables(chunks, size, path)
    if table is None and len(found) != 1:
        raise ValueError(f"{path} has the tables {sorted(found)}")
    if table is not None and table not in found:
        raise KeyError(f"{path} has no table {table!r}")
    variables, first, end = found[table] if table is not None else next(iter(found.values()))
    length = sum(v.length for v in variables)
    count = (end - first) // length
    while count and first + (count - 1) * length > end - RECORD and not _slice(chunks, first + (count - 1) * length, length).strip(b" "):
        count -= 1
    rows = _rows(chunks, first, first + count * length, length)

    def column(v: Variable) -> Column:
        raw = F.substring("raw", v.offset + 1, v.length)
        text = F.regexp_replace(F.decode(raw, encoding), "[ \\x00]+$", "")
        return (ibm_float(F.hex(raw), v.length) if v.numeric else text).alias(v.name)

    return rows.select(*[column(v) for v in variables])
