"""Known licence texts and notices, as fixed values. Their digests are computed, never stored.

Long licences are files of ``licence_files``, word for word as their stewards or distributions ship them; ``.other`` is
a second edition in use.
"""

from importlib.resources import files

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

BSD_2_CLAUSE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

BSD_3_CLAUSE = BSD_2_CLAUSE.replace("""

THIS SOFTWARE""", """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE""")

GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""

MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _file(name: str) -> str:
    return files("tariffmill.llm").joinpath("licence_files", f"{name}.txt").read_text(encoding="utf-8")


def _until(text: str, mark: str) -> str:
    """``text`` before the last ``mark``, such as an appendix on how to apply the licence."""
    return text[:text.rindex(mark)]


def _since(text: str, mark: str) -> str:
    return text[text.index(mark):]


def _titled(text: str, *titles: str) -> list[str]:
    return [text, *(f"{title}\n\n{text}" for title in titles)]


def _bsd(text: str) -> list[str]:
    """The forms in use: numbers or marks before the conditions, holders with "and" or "or" before contributors."""
    plain = text.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")
    return [t.replace("COPYRIGHT HOLDERS AND", f"COPYRIGHT HOLDERS {word}") for t in (text, plain) for word in ("AND", "OR")]


def _full_texts() -> dict[str, list[str]]:
    end, filled = "END OF TERMS AND CONDITIONS", "Copyright 2020 holder"  # a filled-in copyright line is left out like any
    apache = [_file("Apache-2.0"), _file("Apache-2.0.other")]
    apache += [t.replace("Copyright [yyyy] [name of copyright owner]", filled) for t in apache]
    apache += [t[:t.index(end) + len(end)] for t in apache] + [_until(t, end) for t in apache]
    gnu = {
        "GPL-2.0": [_file("GPL-2.0"), _file("GPL-2.0.other")], "GPL-3.0": [_file("GPL-3.0"), _file("GPL-3.0.other")],
        "LGPL-2.1": [_file("LGPL-2.1")],
    }
    for texts in gnu.values():
        texts += [t[:t.index(end) + len(end)] for t in texts] + [_until(t, end) for t in texts]
    mpl, cc0, share_alike, free = (_file(n) for n in ("MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"))
    regents = BSD_3_CLAUSE.replace("name of the copyright holder", "name of the University").replace(
        "COPYRIGHT HOLDERS", "REGENTS").replace("COPYRIGHT HOLDER", "REGENTS")
    return {
        "MIT": _titled(MIT, "MIT License", "The MIT License", "The MIT License (MIT)"),
        "ISC": _titled(ISC, "ISC License", "The ISC License"),
        "BSD-2-Clause": [x for t in _bsd(BSD_2_CLAUSE) for x in _titled(t, "BSD 2-Clause License", "The BSD 2-Clause License")],
        "BSD-3-Clause": [
            x for own in (BSD_3_CLAUSE, BSD_3_CLAUSE.replace("name of the copyright holder nor the names of its", "names of the copyright holders nor the names of their"),
                          BSD_3_CLAUSE.replace("name of the copyright holder nor the names of its", "names of the copyright holders nor the names of its"), regents)
            for t in _bsd(own) for x in _titled(t, "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License")
        ],
        "0BSD": _titled(ZERO_BSD, "BSD Zero Clause License", "Zero-Clause BSD"), "Zlib": _titled(ZLIB, "zlib License"),
        "Apache-2.0": [*apache, APACHE_NOTICE], **gnu, "LGPL-3.0": [_file("LGPL-3.0")],
        "MPL-2.0": [mpl, _until(mpl, "Exhibit B"), _until(mpl, "Exhibit A"), MPL_NOTICE],
        "CC0-1.0": [cc0, _since(cc0, "CC0 1.0 Universal"), _since(cc0, "Statement of Purpose")],
        "CC-BY-SA-4.0": [share_alike, _since(share_alike, "Creative Commons Attribution-ShareAlike 4.0 International Public")],
        "Unlicense": [free, _until(free, "For more information")],
    }


def _gnu_notices() -> list[tuple[str, str]]:
    found = []
    for name, title, version in (
        ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"),
        ("AGPL-3.0", "Affero General", "3"),
    ):
        notice = GNU_NOTICE.replace("GNU General", f"GNU {title}").replace("version 3 of", f"version {version} of")
        only = notice.replace(f"either version {version} of the License, or (at your option) any later\nversion.", f"version {version} of the License.")
        for text in (notice, only):
            found += [(name, text), (name, text.replace("This program", "This library").replace("this program", "this library"))]
        for verb in ("This work is licensed", "Licensed", "Released"):
            found.append((name, f"{verb} under the GNU {title} Public License, version {version}."))
    return found


#: SPDX identifiers and the licence each of them names.
SPDX = {
    **{n: n for n in (
        "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "Zlib", "Apache-2.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0",
        "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    )},
    **{f"{n}{tail}": n for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for tail in ("", "-only", "-or-later")},
}

#: One-line names in notices of the form "Licensed under ...".
NAMES = (
    ("MIT", "the MIT License"), ("ISC", "the ISC License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("Zlib", "the zlib License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("MPL-2.0", "the Mozilla Public License, v. 2.0"), ("Unlicense", "the Unlicense"),
    ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
)

#: (licence, text). A licence may have several texts; one-line notices stand on lines of their own.
KNOWN = (
    *((name, text) for name, texts in _full_texts().items() for text in texts), *_gnu_notices(),
    *((name, f"SPDX-License-Identifier: {spdx}") for spdx, name in SPDX.items()),
    *((name, f"{verb} under {title}.") for name, title in NAMES for verb in ("Licensed", "Released", "This work is licensed", "This project is licensed")),
    ("all-rights-reserved", "All rights reserved."),
)

#: Spellings that count as equal, the second being the one kept.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("catalogue", "catalog"), ("centre", "center"), ("colour", "color"), ("copyrights", "copyright"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"),
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("owner", "holder"),
    ("owners", "holders"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)
