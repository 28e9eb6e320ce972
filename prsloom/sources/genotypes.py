"""Genotype files as Python data sources.

`bed` and `bgen` read ranges of variants in parallel: a partition seeks to its own bytes. A BED record has a fixed length; the
places of a BGEN file's variants come from its .bgi index, or from walking the file once, skipping the probabilities. A partition holds
the places of its own variants only. Equality and membership filters on vidx are pushed down to the ranges, and a bitmap of wanted
variants (`Genotypes.only`) to any number of them. Rows are (vidx, dosage), null a missing call. Files are opened by path, so they must
lie on storage that executors mount.
"""

from __future__ import annotations

import base64
import os
import sqlite3
import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from prsloom.sources import text

MAGIC = b"\x6c\x1b\x01"
#: Calls of each two-bit code: two copies, missing, one, none.
CODES = np.array([2, -1, 1, 0], np.int8)
TABLE = np.array([[CODES[byte >> 2 * k & 3] for k in range(4)] for byte in range(256)], np.int8)
STEP = 1000


@dataclass
class Range(InputPartition):
    numbers: tuple


class _Ranges(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.wanted: set[int] | None = None

    def _numbers(self, m: int) -> list[int]:
        raw = self.options.get("wanted")
        some = range(m) if raw is None else np.flatnonzero(np.unpackbits(np.frombuffer(base64.b64decode(raw), np.uint8), bitorder="little")[:m]).tolist()
        return [x for x in some if self.wanted is None or x in self.wanted]

    def _cut(self, numbers: list) -> list[Range]:
        step = int(self.options.get("step", STEP))
        return [Range(tuple(numbers[a : a + step])) for a in range(0, len(numbers), step)] or [Range(())]


class _Pushed:
    """Takes filters on vidx. Spark refuses readers that could while spark.sql.python.filterPushdown.enabled is off."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("vidx",):
                self._keep({f.value})
            elif isinstance(f, In) and f.attribute == ("vidx",):
                self._keep(set(f.value))
            else:
                yield f

    def _keep(self, numbers: set) -> None:
        self.wanted = numbers if self.wanted is None else self.wanted & numbers


class BedReader(_Ranges):
    def __init__(self, options):
        super().__init__(options)
        self.path, self.n, self.m = options["path"], int(options["samples"]), int(options["variants"])
        self.width = -(-self.n // 4)
        with open(self.path, "rb") as f:
            magic = f.read(3)
            size = f.seek(0, 2)
        if magic[:2] != MAGIC[:2]:
            raise ValueError(f"{self.path}: not a BED file")
        if magic != MAGIC:
            raise ValueError(f"{self.path}: only the variant-major order is supported")
        if size < 3 + self.width * self.m:
            raise ValueError(f"{self.path}: truncated, {size} bytes for {self.m} variants of {self.n} samples")

    def partitions(self):
        return self._cut(self._numbers(self.m))

    def read(self, partition):
        with open(self.path, "rb") as f:
            for v in partition.numbers:
                f.seek(3 + v * self.width)
                calls = TABLE[np.frombuffer(f.read(self.width), np.uint8)].reshape(-1)[: self.n]
                yield v, [None if g < 0 else int(g) for g in calls]


class PushedBedReader(_Pushed, BedReader):
    pass


class BedSource(DataSource):
    """Options: path, samples, variants, step (variants a partition), wanted (a bitmap in base64) and pushdown (true where the session allows it)."""

    @classmethod
    def name(cls):
        return "bed"

    def schema(self):
        return "vidx long, dosage array<tinyint>"

    def reader(self, schema):
        return (PushedBedReader if self.options.get("pushdown") == "true" else BedReader)(self.options)


@dataclass
class BgenIndex:
    samples: list[str] | None
    n_samples: int
    compression: int
    variants: list[tuple]  # id, other id, chrom, pos, first allele, second allele, place and length of the record


def bgi_variants(path: str) -> list[tuple] | None:
    """The variants of a BGEN file from its .bgi index, with the places of their records; None without one."""
    if not os.path.exists(f"{path}.bgi"):
        return None
    with sqlite3.connect(f"file:{path}.bgi?mode=ro", uri=True) as found:
        rows = found.execute("select rsid, chromosome, position, allele1, allele2, file_start_position, size_in_bytes from Variant order by file_start_position").fetchall()
    found.close()
    return [(r[0], r[0], *r[1:3], r[3], r[4] or "", r[5], r[6]) for r in rows]


def bgen_data(raw: bytes) -> int:
    """Where a variant's probabilities start in its record, after names and alleles and their length."""
    at = 0
    for _ in range(3):
        at += 2 + struct.unpack_from("<H", raw, at)[0]
    alleles = struct.unpack_from("<H", raw, at + 4)[0]
    at += 6
    for _ in range(alleles):
        at += 4 + struct.unpack_from("<I", raw, at)[0]
    return at + 4


def bgen_index(path: str) -> BgenIndex:
    """A BGEN file (layout 2): where each variant's record lies, from its index or by walking the file."""

    def take(f, n: int) -> bytes:
        raw = f.read(n)
        if len(raw) != n:
            raise ValueError(f"{path}: truncated")
        return raw

    def number(f, kind: str) -> int:
        return struct.unpack("<" + kind, take(f, struct.calcsize(kind)))[0]

    def word(f, kind: str = "H") -> str:
        return take(f, number(f, kind)).decode()

    with open(path, "rb") as f:
        first, header, m, n = (number(f, "I") for _ in range(4))
        if take(f, 4) not in (b"bgen", b"\0\0\0\0"):
            raise ValueError(f"{path}: not a BGEN file")
        f.seek(header)
        flags = number(f, "I")
        if flags >> 2 & 15 != 2:
            raise NotImplementedError(f"{path}: only layout 2 is supported")
        compression = flags & 3
        if compression == 2:
            raise NotImplementedError(f"{path}: zstd blocks are not supported")
        samples = None
        if flags >> 31:
            f.seek(4 + header)
            number(f, "I")
            samples = [word(f) for _ in range(number(f, "I"))]
        variants = bgi_variants(path)
        if variants is not None:
            if len(variants) != m:
                raise ValueError(f"{path}.bgi lists {len(variants)} variants, the file has {m}")
            return BgenIndex(samples, n, compression, variants)
        f.seek(4 + first)
        variants = []
        for _ in range(m):
            start = f.tell()
            other, rs, chrom, pos = word(f), word(f), word(f), number(f, "I")
            alleles = [word(f, "I") for _ in range(number(f, "H"))]
            length = number(f, "I")
            variants.append((rs or other, other, chrom, pos, alleles[0], alleles[1] if len(alleles) > 1 else "", start, f.tell() - start + length))
            f.seek(length, 1)
    return BgenIndex(samples, n, compression, variants)


def bgen_dosage(raw: bytes, compression: int, n_samples: int) -> np.ndarray:
    """Copies of the first allele by sample, NaN where missing."""
    if compression:
        size = struct.unpack_from("<I", raw)[0]
        raw = zlib.decompress(raw[4:])
        if len(raw) != size:
            raise ValueError("a block has another length than it says")
    n, alleles = struct.unpack_from("<IH", raw)
    if n != n_samples:
        raise ValueError("a block has another number of samples than the file")
    ploidy = np.frombuffer(raw, np.uint8, n, 8)
    missing = ploidy & 0x80 > 0
    phased, bits = raw[8 + n], raw[9 + n]
    if alleles != 2 or phased or np.any(ploidy[~missing] & 0x3F != 2):
        raise NotImplementedError("only unphased diploid calls of two alleles are supported")
    stream = np.frombuffer(raw, np.uint8, offset=10 + n)
    if stream.size * 8 < 2 * n * bits:
        raise ValueError("truncated probabilities")
    if bits in (8, 16, 32):
        p = stream[: 2 * n * bits // 8].view(f"<u{bits // 8}").astype(np.float64)
    else:
        p = np.unpackbits(stream, bitorder="little")[: 2 * n * bits].reshape(2 * n, bits) @ (2.0 ** np.arange(bits))
    p = p.reshape(n, 2) / (2.0**bits - 1)
    return np.where(missing, np.nan, 2 * p[:, 0] + p[:, 1]).astype(np.float32)


class BgenReader(_Ranges):
    def __init__(self, options):
        super().__init__(options)
        self.path = options["path"]

    def partitions(self):
        index = bgen_index(self.path)
        return self._cut([(x, *index.variants[x][6:8], index.compression, index.n_samples) for x in self._numbers(len(index.variants))])

    def read(self, partition):
        with open(self.path, "rb") as f:
            for v, place, length, compression, n in partition.numbers:
                f.seek(place)
                raw = f.read(length)
                if len(raw) != length:
                    raise ValueError(f"{self.path}: truncated")
                dosage = bgen_dosage(raw[bgen_data(raw) :], compression, n)
                yield v, [None if np.isnan(g) else float(g) for g in dosage]


class PushedBgenReader(_Pushed, BgenReader):
    pass


class BgenSource(DataSource):
    """Options: path, step (variants a partition), wanted (a bitmap in base64) and pushdown (true where the session allows it)."""

    @classmethod
    def name(cls):
        return "bgen"

    def schema(self):
        return "vidx long, dosage array<float>"

    def reader(self, schema):
        return (PushedBgenReader if self.options.get("pushdown") == "true" else BgenReader)(self.options)


#: Bytes of a bitmap of wanted variants that travel to the reader: half a billion variants.
MAP_BYTES = 64 << 20


@dataclass
class Genotypes:
    variants: DataFrame  # vidx, id, chrom, pos, a1, a2
    samples: DataFrame  # sidx, fid, iid
    dosage: DataFrame  # vidx, dosage
    m: int = 0
    reader: DataFrameReader | None = None  # what dosage is read by

    def only(self, wanted: DataFrame) -> Genotypes:
        """The same genotypes, of whose dosages only those of the wanted variants (vidx) are read from the file: a bit for each
        variant goes to the reader, up to MAP_BYTES of them (beyond, dosages are joined)."""
        if self.reader is None or self.m > 8 * MAP_BYTES:
            return replace(self, dosage=self.dosage.join(wanted.select("vidx"), "vidx", "left_semi"), reader=None)
        place = F.col("vidx") + 1
        maps = wanted.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
        size = 32768 // 8
        bits = bytearray(-(-max(self.m, 1) // 32768) * size)
        for b, part in maps.collect():  # a bit a variant at most
            bits[(b - 1) * size : b * size] = part
        return replace(self, dosage=self.reader.option("wanted", base64.b64encode(bytes(bits)).decode()).load(), reader=None)


def load_genotypes(spark: SparkSession, path: str, sample_path: str | None = None) -> Genotypes:
    """A .bgen file, or the prefix of .bed, .bim and .fam files."""
    pushdown = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    if path.endswith(".bgen"):
        spark.dataSource.register(BgenSource)
        index = bgen_index(path)
        variants = spark.createDataFrame([(k, *v[:1], *v[2:6]) for k, v in enumerate(index.variants)], "vidx long, id string, chrom string, pos long, a1 string, a2 string")
        if index.samples is not None:
            names = spark.createDataFrame(list(enumerate(index.samples)), "sidx long, iid string")
        elif sample_path:
            names = text.read_sample(spark, sample_path)
            if names.count() != index.n_samples:
                raise ValueError(f"{sample_path} has another number of samples than {path}")
        else:
            names = spark.range(index.n_samples).select(F.col("id").alias("sidx"), F.concat(F.lit("sample_"), F.col("id")).alias("iid"))
        reader = spark.read.format("bgen").option("path", path).option("pushdown", pushdown)
        return Genotypes(variants, names.select("sidx", F.col("iid").alias("fid"), "iid"), reader.load(), len(index.variants), reader)
    for end in (".bed", ".bim", ".fam"):
        path = path.removesuffix(end)
    spark.dataSource.register(BedSource)
    variants, samples = text.read_bim(spark, f"{path}.bim"), text.read_fam(spark, f"{path}.fam")
    m = variants.count()
    reader = spark.read.format("bed").option("path", f"{path}.bed").option("pushdown", pushdown).option("samples", str(samples.count())).option("variants", str(m))
    return Genotypes(variants, samples, reader.load(), m, reader)


# --- writers for tests and small files ------------------------------------------------------------


def write_plink(prefix: str, calls: np.ndarray, variants: list[tuple], samples: list[tuple]) -> None:
    """calls: samples by variants, -1 missing; variants: chrom, id, cm, pos, a1, a2; samples: fid, iid, sex, pheno."""
    n, m = calls.shape
    code = np.array([3, 2, 0, 1], np.uint8)[calls]  # of 0, 1, 2 and -1
    padded = np.zeros((-(-n // 4) * 4, m), np.uint8)
    padded[:n] = code
    four = padded.T.reshape(m, -1, 4)
    with open(f"{prefix}.bed", "wb") as f:
        f.write(MAGIC + (four[..., 0] | four[..., 1] << 2 | four[..., 2] << 4 | four[..., 3] << 6).astype(np.uint8).tobytes())
    with open(f"{prefix}.bim", "w") as f:
        f.writelines("\t".join(map(str, v)) + "\n" for v in variants)
    with open(f"{prefix}.fam", "w") as f:
        f.writelines(f"{fid} {iid} 0 0 {sex} {pheno}\n" for fid, iid, sex, pheno in samples)


def write_bgen(path: str, calls: np.ndarray, variants: list[tuple], samples: list[str] | None = None, bits: int = 8, compress: bool = True) -> None:
    """Whole calls (-1 missing) as layout 2; variants: id, chrom, pos, a1, a2."""
    n, m = calls.shape
    word = lambda x, kind="H": struct.pack("<" + kind, len(x)) + x.encode()
    ids = b""
    if samples is not None:
        body = struct.pack("<I", n) + b"".join(map(word, samples))
        ids = struct.pack("<I", len(body) + 4) + body
    flags = int(compress) | 2 << 2 | (samples is not None) << 31
    out = struct.pack("<IIII", 20 + len(ids), 20, m, n) + b"bgen" + struct.pack("<I", flags) + ids
    top = (1 << bits) - 1
    for v, (name, chrom, pos, a1, a2) in enumerate(variants):
        g = calls[:, v]
        p = np.stack([g == 2, g == 1], 1).astype(np.uint64) * np.uint64(top)
        raw = (p.reshape(-1, 1) >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1)
        body = struct.pack("<IHBB", n, 2, 2, 2) + np.where(g < 0, 0x82, 2).astype(np.uint8).tobytes() + bytes([0, bits]) + np.packbits(raw, bitorder="little").tobytes()
        block = struct.pack("<I", len(body)) + zlib.compress(body) if compress else body
        out += word(name) + word(name) + word(str(chrom)) + struct.pack("<IH", pos, 2) + word(a1, "I") + word(a2, "I") + struct.pack("<I", len(block)) + block
    with open(path, "wb") as f:
        f.write(out)
