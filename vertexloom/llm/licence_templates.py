"""Whole licence texts, customary header blocks, names and SPDX ids, compared by fixed weights."""

from __future__ import annotations

from pathlib import Path

FOLDER = Path(__file__).parent / "licence_texts"

#: Licence by file of ``licence_texts``.
FILES = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_IF = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_AS_IS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_AFFERO = "Remote Network Interaction; Use with the GNU General Public License. If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version."


def _gnu(name: str, version: str) -> list[str]:
    """The first two paragraphs of the header of a GNU licence, and both with the third."""
    first = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    only = f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."
    second = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    third = f"You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    return [first, only, f"{first} {second} {third}", f"{only} {second} {third}", f"GNU {name} version {version}", f"GNU {name} v{version}"]


#: Licence, short names.
_NAMES = [
    ("Apache-2.0", ["Apache-2.0", "Apache License 2.0", "Apache License Version 2.0"]),
    ("MIT", ["MIT", "MIT License", "The MIT License (MIT)"]),
    ("BSD-2-Clause", ["BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD-3-Clause", "BSD 3-Clause License", "New BSD License"]),
    ("ISC", ["ISC", "ISC License"]),
    ("GPL-2.0", ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GNU GPL v2", "GPL v2", "GPLv2"]),
    ("GPL-3.0", ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GNU GPL v3", "GPL v3", "GPLv3"]),
    ("LGPL-2.1", ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "GNU LGPL v2.1", "LGPLv2.1"]),
    ("LGPL-3.0", ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "GNU LGPL v3", "LGPLv3"]),
    ("AGPL-3.0", ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL v3", "AGPLv3"]),
    ("MPL-1.1", ["MPL-1.1"]),
    ("MPL-2.0", ["MPL-2.0", "Mozilla Public License 2.0"]),
    ("CC-BY-4.0", ["CC-BY-4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4.0", "Creative Commons Attribution ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial 4.0 International License"]),
    ("CC0-1.0", ["CC0-1.0", "CC0 1.0 Universal"]),
    ("GFDL-1.3", ["GFDL-1.3", "GFDL-1.3-only", "GFDL-1.3-or-later"]),
    ("Artistic-1.0", ["Artistic-1.0", "The Artistic License"]),
]


def names() -> list[tuple[str, str]]:
    """Short names: they are all there is of a text, so they hold for whole files and lines alike."""
    out = [(licence, n) for licence, of in _NAMES for n in of]
    return out + [(licence, f"SPDX-License-Identifier: {n}") for licence, of in _NAMES for n in of if "-" in n or n in ("MIT", "ISC")]


def texts() -> list[tuple[str, str]]:
    """Whole texts and header blocks."""
    whole = [(licence, (FOLDER / f"{name}.txt").read_text()) for name, licence in FILES.items()]
    gpl = dict(whole)["GPL-3.0"]
    # The Affero text is that of the GPL but for its name and section 13.
    affero = gpl.replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public") + _AFFERO
    bsd2 = [_BSD_IF, _BSD_1, _BSD_2, _BSD_AS_IS]
    bsd3 = [_BSD_IF, _BSD_1, _BSD_2, _BSD_3, _BSD_AS_IS]
    out = whole + [
        ("AGPL-3.0", affero),
        ("MIT", f"MIT License\n{_MIT}\n{_MIT_KEEP}\n{_AS_IS}"),
        ("MIT", _MIT),
        ("BSD-2-Clause", "\n".join(bsd2)),
        ("BSD-3-Clause", "\n".join(bsd3)),
        ("ISC", f"ISC License\n{_ISC}\n{_ISC_AS_IS}"),
        ("ISC", _ISC),
        ("Apache-2.0", f"{_APACHE}\n{_APACHE_AS_IS}"),
        ("Apache-2.0", _APACHE),
        ("MPL-2.0", _MPL),
    ]
    for licence, name, version in [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")]:
        out += [(licence, t) for t in _gnu(name, version)]
    return out
