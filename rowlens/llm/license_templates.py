"""Licence templates as data: windows of the licences' own texts, names they go by, and SPDX identifiers.

A licence has several windows, each a stretch of its text that no other licence
here has, so that a file with a part of the text is told as well as one with all
of it. ``WINDOWS`` holds (name, label, stretch, key phrases that must stand in it);
``NAMES`` and ``SPDX`` become templates by rule, which are their own key phrase.
"""

from __future__ import annotations

import re

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

WINDOWS = (
    ("mit-release", "mit", "released under the MIT License", ("mit license",)),
    ("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy", ("permission is hereby granted", "free of charge")),
    ("mit-notice", "mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("this permission notice shall be included in all copies or substantial portions",)),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-basis", "apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", ("software distributed under the license is distributed on an",)),
    ("apache-grant", "apache", "a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of", ("no charge royalty free irrevocable copyright license",)),
    ("gpl-3", "gpl", "This work is licensed under the GNU General Public License version 3", ("gnu general public license",)),
    ("gpl-2", "gpl", "under the terms of the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-notice", "gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license as published by",)),
    ("gpl-short", "gpl", "licensed under the GPL", ("under the gpl",)),
    ("lgpl", "lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    ("cc-by-nc", "cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "cc-by", "licensed under CC BY 4.0", ("cc by 4",)),
    ("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use", "source and binary forms")),
    ("bsd-source", "bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-binary", "bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-names", "bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("isc", "isc", "to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("mpl-2", "mpl", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("mpl-form", "mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at", ("a copy of the mpl was not distributed with this file",)),
    ("boost", "boost", "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", ("use reproduce display distribute execute and transmit the software",)),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("unlicense-grant", "unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free to copy modify publish use compile sell or distribute this software",)),
    ("zlib", "zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", ("altered source versions must be plainly marked as such",)),
    ("zlib-origin", "zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software", ("the origin of this software must not be misrepresented",)),
    ("epl", "epl", "the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("cc0", "cc0", "waived all copyright and related or neighboring rights to", ("all copyright and related or neighboring rights to",)),
)

#: Names in running text and their labels.
NAMES = {
    "BSD License": "bsd",
    "BSD 3-Clause": "bsd",
    "BSD 2-Clause": "bsd",
    "ISC License": "isc",
    "Boost Software License": "boost",
    "zlib License": "zlib",
    "Lesser General Public License": "lgpl",
    "Affero General Public License": "agpl",
    "Artistic License": "artistic",
    "European Union Public Licence": "eupl",
    "CC0 1.0 Universal": "cc0",
    "Creative Commons Attribution 4.0": "cc-by",
    "Creative Commons Attribution-ShareAlike": "cc-by-sa",
    "Creative Commons Attribution-NonCommercial": "cc-by-nc",
}

#: SPDX identifiers and their labels; what follows an identifier ("-only", "-or-later") doesn't matter.
SPDX = {
    "MIT": "mit",
    "Apache-2.0": "apache",
    "GPL-2.0": "gpl",
    "GPL-3.0": "gpl",
    "LGPL-2.1": "lgpl",
    "LGPL-3.0": "lgpl",
    "AGPL-3.0": "agpl",
    "BSD-2-Clause": "bsd",
    "BSD-3-Clause": "bsd",
    "ISC": "isc",
    "MPL-2.0": "mpl",
    "BSL-1.0": "boost",
    "Unlicense": "unlicense",
    "Zlib": "zlib",
    "EPL-2.0": "epl",
    "EUPL-1.2": "eupl",
    "Artistic-2.0": "artistic",
    "CC0-1.0": "cc0",
    "CC-BY-4.0": "cc-by",
    "CC-BY-SA-4.0": "cc-by-sa",
    "CC-BY-NC-4.0": "cc-by-nc",
}


def words_of(text: str) -> str:
    """A template's words in lower case, space-joined, as documents are read."""
    return " ".join(_WORD.findall(text.lower()))


def templates() -> tuple[tuple[str, str, str, tuple[str, ...]], ...]:
    """(name, label, notice, key phrases) of all templates."""
    found = [(name, label, words_of(text), phrases) for name, label, text, phrases in WINDOWS]
    for text, label in [*NAMES.items(), *((f"SPDX-License-Identifier: {i}", label) for i, label in SPDX.items())]:
        own = words_of(text)
        found.append((own.replace(" ", "-"), label, own, (own,)))
    return tuple(found)
