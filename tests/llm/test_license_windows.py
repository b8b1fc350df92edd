"""Notices inside lines and paragraphs, wrapped headers and whole licence files."""

from attestra.llm import licenses

from .test_licenses import FILES

WORDS = "the river bank lies near an old mill where boats were built and sold for many years before anyone thought of writing it down "
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 */
"""
MIT = """The MIT License (MIT)

Copyright (c) 2020 Some One. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software
without restriction.
"""
BSD = """Copyright 2020 The Authors. All rights reserved.
Use of this source code is governed by a BSD-style license that can be
found in the LICENSE file.
"""
CASES = [
    (WORDS * 2 + "Released under the MIT License. " + WORDS * 2, "MIT"),
    (WORDS + "It is licensed under the Apache License, Version 2.0, as " + WORDS, "Apache-2.0"),
    ("Licensed under the MIT License or the Apache License, Version 2.0, at your option.", "MIT"),
    (GPL.format("", 3), "GPL-3.0"),
    (GPL.format("", 2), "GPL-2.0"),
    (GPL.format("Lesser ", 3), "LGPL-3.0"),
    (GPL.format("Affero ", 3), "AGPL-3.0"),
    (BSD, "BSD-3-Clause"),
    (MIT, "MIT"),
    ("    GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n" + (WORDS + "\n") * 90, "GPL-3.0"),
    ((WORDS + "\n") * 90 + "// SPDX-License-Identifier: MPL-2.0 " + WORDS, "MPL-2.0"),
    ("Copyright 2020 Some One. All rights reserved.\n" + WORDS, "Proprietary"),
    (WORDS + "the driver's license was renewed " + WORDS, None),
]


TEXT = dict(licenses.TEXTS)
#: Text, licence, all licences.
PROBES = [
    ("/*\n * " + TEXT["BSD-2-Clause"] + "\n */\nint main() { return 0; }\n" + WORDS * 3, "BSD-2-Clause", ["BSD-2-Clause"]),
    ("/*\n * " + TEXT["BSD-3-Clause"] + "\n */\nint main() { return 0; }\n" + WORDS * 3, "BSD-3-Clause", ["BSD-3-Clause"]),
    (WORDS + TEXT["ISC"] + WORDS, "ISC", ["ISC"]),
    ("This is not released under the MIT License " + WORDS, None, []),
    ("This software was never licensed under the Apache License, Version 2.0. " + WORDS, None, []),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\n" + WORDS, "Apache-2.0", ["Apache-2.0", "MIT"]),
    ("// SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)\n" + WORDS, "BSD-3-Clause", ["BSD-3-Clause", "GPL-2.0"]),
    (WORDS + "available under the MIT license. " + WORDS, "MIT", ["MIT"]),
    (WORDS + "licensed under the GPLv3 " + WORDS, "GPL-3.0", ["GPL-3.0"]),
    ("Name: thing\nLicense: GPL-2.0-or-later\n" + WORDS, "GPL-2.0", ["GPL-2.0"]),
    ("# SPDX-License-Identifier: EPL-2.0\n" + WORDS, "EPL-2.0", ["EPL-2.0"]),
    ("# SPDX-License-Identifier: BSL-1.0\n" + WORDS, "BSL-1.0", ["BSL-1.0"]),
    ("# SPDX-License-Identifier: Zlib\n" + WORDS, "Zlib", ["Zlib"]),
]


def test_texts_choices_negations_and_identifiers(spark):
    rows = [(k, f"{k}/f.c", text, "x") for k, (text, *_) in enumerate(PROBES)]
    got = {r.id: (r.license, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {k: (name, every) for k, (_, name, every) in enumerate(PROBES)}


def test_notices_in_context(spark):
    rows = [(k, f"{k}/f.txt", text, "x") for k, (text, _) in enumerate(CASES)]
    got = {r.id: r.license for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {k: name for k, (_, name) in enumerate(CASES)}


def test_templates_fit_blocks():
    for _, text, need in licenses.NOTICES:
        assert need and set(licenses.words(need)) <= set(licenses.words(text)) and len(licenses.words(text)) <= licenses.BLOCK
