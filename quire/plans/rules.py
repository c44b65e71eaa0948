"""Rule dimensions: the fixed values that results depend on, and small frames of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Colours of categories.
CATEGORY_COLORS = {
    "title": "#FF6347",
    "text_block": "#4169E1",
    "figure": "#2E8B57",
    "table": "#FFA500",
    "list": "#9370DB",
    "header": "#FF00FF",
    "footer": "#00FFFF",
    "figure_caption": "#A52A2A",
    "table_caption": "#A52A2A",
    "equation_isolated": "#008080",
    "default": "#343a40",
    "page_number": "#808080",
}

# Keys that an annotation of a category must have, besides the
# common ones, which always count as present.
REQUIRED_KEYS = {
    "equation_isolated": ["latex", "attribute.equation_language", "attribute.formula_type"],
    "table": ["html", "table_edit_status", "attribute.line", "attribute.table_layout", "attribute.language"],
    "figure": ["attribute.contains_elements", "sub_regions"],
    "chart": ["html", "attribute.chart_type", "attribute.language", "attribute.is_indexed"],
}

# Bounds of text lengths by document type and category.
TEXT_LENGTH_RULES = {
    "PP": {"title": (5, 150), "text_block": (20, 500), "abstract": (50, 500), "caption": (5, 100), "equation": (1, 50), "reference": (10, 200)},
    "PR": {"title": (3, 80), "text_block": (5, 200), "caption": (3, 50), "list_item": (3, 100)},
    "DEFAULT": {
        "title": (3, 150),
        "text_block": (5, 500),
        "caption": (3, 100),
        "table": (5, 500),
        "list_item": (3, 200),
        "figure": (0, 50),
        "chart": (0, 100),
    },
}

# Bounds of a box's share of the page and of its aspect.
BBOX_SIZE_RULES = {
    "DEFAULT": {
        "title": (0.01, 0.2, 2.0, 15.0),
        "text_block": (0.01, 0.6, 0.3, 5.0),
        "figure": (0.05, 0.7, 0.3, 3.0),
        "table": (0.05, 0.8, 0.3, 5.0),
        "caption": (0.005, 0.15, 2.0, 10.0),
        "chart": (0.05, 0.7, 0.5, 3.0),
    }
}

# Document type codes and their names.
DOC_TYPES = {
    "CB": "기업보고서",
    "EX": "문제집",
    "ET": "기타",
    "GR": "정부보고서",
    "IR": "IR자료",
    "IT": "소개자료",
    "LT": "강의자료",
    "MG": "매뉴얼/가이드",
    "PB": "간행물",
    "PP": "논문",
    "PR": "발표자료",
    "RP": "리포트",
    "RT": "보고서",
    "SK": "SKON문서",
}

# Categories whose text must not be blank; whose text is checked
# for formulas without markup; whose characters are counted; that give training pairs.
TEXT_REQUIRED = ("text_block", "title", "header", "footer", "list_item", "table_caption", "figure_caption", "page_footnote")
INLINE_CHECKED = ("text_block", "chart_caption", "table_caption")
CHARSET_CATEGORIES = ("text_block", "title", "list", "list_item", "header", "footer", "page_number", "figure_caption", "table_caption", "page_footnote")
TRAINING_CATEGORIES = ("title", "header", "footer", "page_number", "figure_caption", "table_caption", "page_footnote", "list_item")

# Patterns of formulas without markup, in order, and what each suggests.
INLINE_PATTERNS = (
    (r"[a-zA-Z][0-9]_[a-zA-Z0-9]", "subscript"),
    (r"[a-zA-Z]\^[a-zA-Z0-9]", "superscript"),
    (r"\\[a-zA-Z]+", "macro"),
    (r"[0-9]+\s*[xX]\s*[0-9]+", "product"),
    (r"[a-zA-Z0-9]+/[a-zA-Z0-9]+", "fraction"),
)

# Macros that formulas may use.
KNOWN_MACROS = (
    "frac", "sqrt", "sum", "int", "lim", "sin", "cos", "tan", "log", "ln", "exp", "alpha", "beta", "gamma", "delta", "epsilon", "theta", "phi",
    "psi", "omega", "mathrm", "mathbf", "mathit", "text", "left", "right", "begin", "end", "label", "ref", "cdot", "times", "leq", "geq", "le",
    "ge", "neq", "pm", "mp",
)

# Flags of tables by the category of the child that each promises.
INCLUDE_FLAGS = {"include_photo": "figure", "include_chart": "chart", "include_table": "table"}

SPATIAL_OVERLAP = 0.90


def required_keys(spark: SparkSession) -> DataFrame:
    rows = [(c, k) for c, keys in REQUIRED_KEYS.items() for k in keys]
    return spark.createDataFrame(rows, "category string, required_key string")


def text_length_rules(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    rows = [(t, c, *b[:2]) for t, by in (rules or TEXT_LENGTH_RULES).items() for c, b in by.items()]
    return spark.createDataFrame(rows, "doc_type string, category string, min_len int, max_len int")


def bbox_size_rules(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    rows = [(t, c, *map(float, b)) for t, by in (rules or BBOX_SIZE_RULES).items() for c, b in by.items()]
    return spark.createDataFrame(rows, "doc_type string, category string, min_ratio double, max_ratio double, min_aspect double, max_aspect double")


def doc_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*DOC_TYPES.items()], "doc_type string, doc_type_name string")


def category_colors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*CATEGORY_COLORS.items()], "category string, color string")
