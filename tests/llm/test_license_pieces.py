"""Licences beside copyright lines, in code and as whole files."""

import textwrap

import pytest

from roadtrace.llm import license_scan as ls

MIT = textwrap.fill(ls._MIT, 76) + "\n\n" + textwrap.fill("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 76) + "\n\n" + textwrap.fill(ls._ANY_KIND, 76)
APACHE = textwrap.fill(ls._APACHE, 76) + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + textwrap.fill(ls._APACHE_END, 76)
CODE = "\n\nimport os\n\ndef main(argument):\n    return os.path.join(argument, 'some', 'other', 'words')\n" * 9
TEXTS = {
    "header beside a copyright": ("Copyright 2020 Foo Bar Inc.\nLicensed under the Apache License, Version 2.0", "apache-2.0"),
    "spdx mit": ("// SPDX-License-Identifier: MIT" + CODE, "mit"),
    "spdx apache": ("# SPDX-License-Identifier: Apache-2.0" + CODE, "apache-2.0"),
    "spdx gpl": ("# Copyright (C) A. Uthor\n# SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
    "spdx of no template": ("# SPDX-License-Identifier: Zlib", None),
    "apache header": ("\n".join("# " + x for x in f"Copyright 2020 Foo Bar Inc.\n\n{APACHE}".split("\n")) + CODE, "apache-2.0"),
    "mit file": (f"Copyright (c) 2020 Foo Bar Inc.\n\n{MIT}", "mit"),
    "mit file with a title": (f"MIT License\n\nCopyright (c) 2020 Foo\n\n{MIT}", "mit"),
    "bsd 3 file": (f"Copyright (c) 2019, Foo\n{textwrap.fill(ls._BSD)}\n\n{textwrap.fill(ls._NEITHER)}\n\n{textwrap.fill(ls._BSD_END)}", "bsd-3-clause"),
    "bsd 2 file": (f"Copyright (c) 2019, Foo\n{textwrap.fill(ls._BSD)}\n\n{textwrap.fill(ls._BSD_END)}", "bsd-2-clause"),
    "isc file": (f"Copyright (c) 2019, Foo\n\n{textwrap.fill(ls._ISC)}", "isc"),
    "gpl 3 head": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n", "gpl-3.0"),
    "gpl 2 header": (textwrap.fill(ls._GNU.format("program", "", "2"), 70) + CODE, "gpl-2.0"),
    "lgpl header": (textwrap.fill(ls._GNU.format("library", "Lesser ", "3"), 70) + CODE, "lgpl-3.0"),
    "copyright only": ("Copyright 2020 Foo Bar Inc.\nAll rights reserved", None),
    "talk of licences": ("You need a driving license to hire a car here.\nNo warranty is given for lost keys", None),
    "no marker": ("plain words", None),
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, f"{i}/f.txt", t) for i, (t, _) in enumerate(TEXTS.values())], "doc_id long, path string, text string")
    rows = ls.scan_licenses(df, id_col="doc_id", path="path", templates=ls.FULL, pieces=True).collect()
    assert len(rows) == len(TEXTS)
    return {list(TEXTS)[r["doc_id"]]: r["own_license"] for r in rows}


@pytest.mark.parametrize("name", TEXTS)
def test_piece_names_the_licence(got, name):
    assert got[name] == TEXTS[name][1]
