"""Source files made from a table's keys, so that SQL can tell what a scan must find without parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Template number -> source. What each yields under 3.11 through 3.13 is what the queries' SQL says.
TEMPLATES = [
    "import cgi\n",
    "import telnetlib as t\nt.Telnet('h')\n",
    "from uu import encode\n",
    "import sys\nif sys.version_info < (3, 13):\n    import crypt\nelse:\n    import pipes\n",
    "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import aifc\n",
    "import importlib\nimportlib.import_module('imghdr')\n",
    "x = ~True\n",
    "import xml.etree\nimport distutils.core\nimport distutils.core\n",
    "import nis  # driftgauge: ignore[CPY0012] -- kept\n",
    "def f(locale):\n    return locale.format('x')\n",
    "import locale\ndef f():\n    return locale.format('x'), locale.format('y')\n",
    "import shutil\nshutil.rmtree('x', onerror=None)\nshutil.rmtree('y')\n",
    "def broken(:\n",
    "print('nothing here')\n",
    "if a:\n    import imp as m\nelse:\n    import json as m\nm.load()\n",
    "import ssl\nssl.wrap_socket(s)\n",
]


def corpus(df: DataFrame, key: str) -> DataFrame:
    """(path, source) of one file for each key."""
    t = F.array(*map(F.lit, TEMPLATES))
    k = F.col(key).cast("long")
    return df.select(F.concat(F.lit("pkg"), F.pmod(k, F.lit(16)), F.lit("/m"), k, F.lit(".py")).alias("path"), F.element_at(t, (F.pmod(k, F.lit(len(TEMPLATES))) + 1).cast("int")).alias("source"))
