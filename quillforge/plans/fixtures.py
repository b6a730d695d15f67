"""Stated examples and word lists. They must equal those of the rules they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Technical destinations beyond the word lists.
TECHNICAL_WORDS = (
    "booleans", "cacheable", "composability", "composable", "deallocate", "deallocated", "deallocates", "deallocating", "deallocation", "deallocations",
    "filesystem", "filesystems", "lifecycle", "lifecycles", "middleware", "namespace", "namespaces", "runtimes", "templated", "templating",
)

#: Typos and their corrections.
PAIRS = {
    "seperately": "separately", "sepparately": "separately", "cconfiguration": "configuration", "accommmodation": "accommodation", "looknig": "looking", "meeitng": "meeting",
    "upadted": "updated", "payemnts": "payments", "pracitcal": "practical", "partenrship": "partnership", "requirse": "requires", "accounst": "accounts", "achievde": "achieved",
    "mgiht": "might", "mihgt": "might", "rgiht": "right", "wolrd": "world", "abotu": "about", "hte": "the", "seperate": "separate", "wiht": "with", "wtih": "with", "taht": "that",
    "thsi": "this", "yuo": "you", "tthe": "the", "knwo": "know", "hwere": "where", "wehther": "whether", "aviod": "avoid", "birng": "bring", "whch": "which", "whih": "which",
    "wgich": "which", "eithr": "either", "myslf": "myself", "peiod": "period", "bieng": "being", "leauge": "league", "buisy": "busy", "edege": "edge", "ladiy": "lady",
    "loucd": "loud", "neack": "neck", "aufful": "awful", "direnk": "drink", "enmeny": "enemy", "ftigh": "fight", "furiht": "fruit", "sheepe": "sheep", "probebly": "probably",
    "rimember": "remember", "thousend": "thousand", "peolpe": "people", "pepole": "people", "eachother": "each other", "fromthe": "from the", "wantto": "want to",
}

#: Words that no lookup may change.
UNCHANGED = ("form", "from", "weather", "wth", "fomr", "infact", "teh", "buidl", "alot", "dont", "HTE", "Hte", "hTe", "foo_hte", "1hte", "éhte", "htex")

_PATHS = "/tmp/definately/f ./definately ../definately ~/definately definately/f docs\\definately C:\\definately \\\\server\\definately definately"

#: (file type, text, corrected text); the catalogue has definately -> definitely.
CONTEXTS = [
    ("markdown", "definately `definately` definately", "definitely `definately` definitely"),
    ("markdown", "`definately", "`definately"),
    ("markdown", "``definately ` definately`` definately", "``definately ` definately`` definitely"),
    ("markdown", "\\`definately", "\\`definitely"),
    ("markdown", "```definately``` definately", "```definately``` definitely"),
    ("markdown", "> ```\n> definately\ndefinately", "> ```\n> definately\ndefinitely"),
    ("markdown", "```\ndefinately\n```\ndefinately", "```\ndefinately\n```\ndefinitely"),
    ("markdown", "    definately", "    definately"),
    ("markdown", "`first\ndefinately` definately", "`first\ndefinately` definitely"),
    ("markdown", "[definately](https://example.com/definately) definately", "[definitely](https://example.com/definately) definitely"),
    ("markdown", "https://example.com/definately www.definately.com me@definately.com definately", "https://example.com/definately www.definately.com me@definately.com definitely"),
    ("markdown", '[docs]: definately "definately"', '[docs]: definately "definitely"'),
    ("markdown", "[docs]:\ndefinately\ndefinately", "[docs]:\ndefinately\ndefinitely"),
    ("markdown", "[^note]: definately", "[^note]: definitely"),
    ("markdown", '<a href="definately">definately</a> definately', '<a href="definately">definitely</a> definitely'),
    ("markdown", "<a\ntitle=definately\n> definately", "<a\ntitle=definately\n> definitely"),
    ("markdown", "---\ntitle: definately\n---\ndefinately", "---\ntitle: definately\n---\ndefinitely"),
    ("markdown", "---\ntitle: definately\n...\ndefinately", "---\ntitle: definately\n...\ndefinitely"),
    ("markdown", "prose\n---\ndefinately", "prose\n---\ndefinitely"),
    ("gitcommit", "`definately` definately", "`definately` definitely"),
    ("gitcommit", "```\ndefinately\n```\ndefinately", "```\ndefinately\n```\ndefinitely"),
    ("gitcommit", "---\ndefinately", "---\ndefinitely"),
    ("text", "/tmp/definately", "/tmp/definitely"),
    ("lua", "definately", "definately"),
    ("markdown", _PATHS, _PATHS.removesuffix("definately") + "definitely"),
    ("gitcommit", _PATHS, _PATHS.removesuffix("definately") + "definitely"),
]

#: (comment, whether its end is protected)
COMMENTS = [
    ("-- prose definately", False),
    ("-- `definately", True),
    ("-- `code` definately", False),
    ("// ```\n// definately", True),
    ("// ```\n// code\n// ```\n// definately", False),
    ("/* ~~~\n * definately", True),
    ("# > ```\n# > definately", True),
]

def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*PAIRS.items(), ("definately", "definitely")], "typo string, correction string")
