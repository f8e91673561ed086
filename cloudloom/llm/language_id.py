"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary made of labelled text. A text is cut into blocks, so that the
dictionary matters to the end of a long text, and every block, in lower case, is compressed with every dictionary. The smallest
sum wins; its lead over the second, as a share, is the score, and a narrow lead is marked as rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.tables import lean
from cloudloom.session import cut_lineage

TRAIN_ROWS = 600  # labelled rows per language that make its dictionary, chosen by a hash of the text
DICT_BYTES = 1 << 17  # of a dictionary
BLOCK_BYTES = 1 << 12
LEVEL, MIN_MATCH = 3, 4  # words are short, and so are the matches that tell languages apart
MIN_MARGIN = 0.005
MAX_LANGUAGES = 400
UNDETERMINED = "und"

_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numerals that are no digits


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def fit_dictionaries(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, dict_bytes: int = DICT_BYTES
) -> dict[str, bytes]:
    """Dictionary bytes per language, from at most `train_rows` distinct texts of each, at most `dict_bytes` in all.

    The texts are the first by a hash, so the choice hangs neither on partitions nor on copies. Each gives a piece from a place that
    the hash tells, and the pieces are as long as lets all of them into the dictionary. Rows without text or language teach nothing. More than MAX_LANGUAGES languages are an error.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND length(text) > 0")
    rows = rows.select("lang", F.xxhash64("text").alias("pick"), "text")
    counts = rows.select("lang", "pick").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # of a large language, about four times the texts wanted take part in the choice
    rows = rows.withColumn("pick", F.pmod("pick", F.lit(1 << 40)))
    few = F.lit(True)
    for r in counts:
        if r["n"] > 4 * train_rows:
            few = few & ((F.col("lang") != r["lang"]) | (F.col("pick") < int((1 << 40) * 4 * train_rows / r["n"])))
    first = Window.partitionBy("lang").orderBy("pick", "text")
    rows = rows.filter(few).groupBy("lang", F.col("pick")).agg(F.min("text").alias("text"))  # copies combine before they move
    rows = rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= train_rows)
    rows = cut_lineage(rows.withColumn("size", F.octet_length(F.lower("text"))))
    sizes = rows.groupBy("lang").agg(F.collect_list("size").alias("sizes")).collect()
    shares = {r["lang"]: _share(r["sizes"], dict_bytes) for r in sizes}
    if not shares:
        return {}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    begin = F.pmod("pick", F.greatest(F.length("text") - share, F.lit(0)) + 1).cast("int") + 1
    made = rows.select("lang", "at", F.col("text").substr(begin, share).alias("text"))
    made = made.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return {r["lang"]: b"\n".join(p["text"].lower().encode()[: shares[r["lang"]]] for p in r["parts"]) for r in made.collect()}


def _share(sizes: list[int], total: int) -> int:
    """The longest piece, in bytes, at which pieces of all texts and the ends between them fit into `total`."""
    room = total - len(sizes) + 1
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) >= room:
            return max(1, room // (len(sizes) - k))
        room -= size
    return max(1, *sizes, 1)


class Compressors:
    """One compressor per language, with its dictionary digested once."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(
            level, strategy=zstandard.STRATEGY_GREEDY, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self.by_name = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            self.by_name.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))

    def judge(self, text: str | None, block: int = BLOCK_BYTES) -> tuple[str, float]:
        """(language, score). The score is the lead over the second smallest; 1 with a single language, 0 for a tie."""
        if not text or not self.names or not has_letter(text):
            return UNDETERMINED, 0.0
        data = text.lower().encode()
        blocks = [data[i : i + block] for i in range(0, len(data), block)]
        if len(blocks) > 1 and len(blocks[-1]) < block // 2:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        sizes = []
        for c in self.by_name:
            one = c.compress
            sizes.append(sum([len(one(b)) for b in blocks]))
        order = sorted(range(len(sizes)), key=sizes.__getitem__)  # of a tie the first name
        best = sizes[order[0]]
        if len(order) == 1:
            return self.names[0], 1.0
        second = sizes[order[1]]
        return self.names[order[0]], (second - best) / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """All columns of `docs` with lang_pred, score (0 to 1) and rejected.

    Null texts and texts without a letter are `und`, with score 0, and rejected; so is a lead below `min_margin` (its
    language is still told). Whole texts are judged. No rows give no rows; columns named like a result are replaced.
    """
    results = ("lang_pred", "score", "rejected")
    own = [c for c in docs.columns if c not in results]
    packed = docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_text"))
    row_type = packed.schema["_row"].dataType.simpleString()

    def fn(batches):
        judge = Compressors(dictionaries).judge
        for batch in batches:
            found = [judge(t) for t in batch.column("_text").to_pylist()]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            rejected = [n == UNDETERMINED or s < min_margin for n, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                schema=pa.schema([batch.schema.field("_row"), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]),
            )

    out = packed.mapInArrow(lean(fn), f"_row {row_type}, lang_pred string, score double, rejected boolean")
    return out.select("_row.*", *results)


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the id in decimal."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
