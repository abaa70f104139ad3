"""Names, parameters and row types that operators share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """How paths name projects, builds and document types."""

    enterprise: str = "global"
    shared_build: str = "common"
    #: Folder name to document type.
    folders: dict[str, str] = field(default_factory=lambda: {
        "datasheet": "datasheet", "schematic": "schematic", "sch": "schematic", "sop": "sop", "note": "note", "report": "report",
    })


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 1500
    overlap_chars: int = 100
    min_chars: int = 50
    excerpt_chars: int = 200


@dataclass(frozen=True)
class Retrieval:
    dense_k: int = 4
    sparse_k: int = 4
    final_k: int = 8
    sufficient_score: float = -3.0
    quotas: tuple[int, int, int] = (6, 2, 2)
    minimum_score: float | None = None
    weak_score: float = -4.0
    scope_inheritance: bool = True
    scope_cascade: bool = True
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    excerpt_chars: int = 512
    expand_sections: bool = False


@dataclass(frozen=True)
class Evaluation:
    fact_recall: float = 0.6
    negative_ceiling: float = -2.0
    preview_chars: int = 240
    mandatory_rate: float = 0.90
    negative_rate: float = 1.0


LAYOUT, CHUNKING, RETRIEVAL, EVALUATION = Layout(), Chunking(), Retrieval(), Evaluation()

METADATA = T.StructType([
    T.StructField("project", T.StringType(), False), T.StructField("build", T.StringType(), False), T.StructField("document_type", T.StringType(), False),
    T.StructField("title", T.StringType(), False), T.StructField("source_file", T.StringType(), False), T.StructField("target_file", T.StringType()),
    T.StructField("source_mtime", T.DoubleType()), T.StructField("source_size", T.LongType()), T.StructField("page", T.IntegerType()),
    T.StructField("major_components", T.ArrayType(T.StringType())), T.StructField("nets", T.ArrayType(T.StringType())), T.StructField("interfaces", T.ArrayType(T.StringType())),
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("version", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("target_file", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("chunk_id", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("heading_path", T.StringType()), T.StructField("excerpt", T.StringType()),
])
