"""Public license texts and notices that the license scan looks for.

The words in ``[[...]]`` tell a license from its neighbours (version, clause, name): a match must
hold them in one piece. Whole texts of long licenses are the files in ``licenses``, read by the
driver only.
"""

import os

_TEXTS = os.path.join(os.path.dirname(__file__), "licenses")


def _whole(name: str, *keys: str) -> str:
    """The text of a file, with the given phrases marked."""
    with open(os.path.join(_TEXTS, f"{name}.txt"), encoding="utf-8") as f:
        text = " ".join(f.read().split())
    for key in keys:
        assert key in text, (name, key)
        text = text.replace(key, f"[[{key}]]", 1)
    return text


_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to "
)
_MIT_NOTICE = (
    "permit persons to whom the Software is furnished to do so, [[subject to the following conditions]]: The above copyright notice and this "
    "permission notice [[shall be included in all copies]] or substantial portions of the Software. "
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
)
_X11_NAME = (
    "Except as contained in this notice, the name of the copyright holders [[shall not be used in advertising or otherwise to promote the sale]], "
    "use or other dealings in this Software without prior written authorization from the copyright holders."
)

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
)
_BSD_BINARY = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_LAST = _BSD_BINARY.replace("provided with the distribution. ", "[[provided with the distribution. THIS SOFTWARE IS PROVIDED]]")
_BSD_ADVERTISING = (
    "3. [[All advertising materials mentioning features or use of this software must display the following acknowledgement]]: This product "
    "includes software developed by the organization. "
)
_BSD_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be [[used to endorse or promote products derived from this "
    "software]] without specific prior written permission. "
)
_BSD_WARRANTY = (
    " BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_PROVIDED = "THIS SOFTWARE IS PROVIDED" + _BSD_WARRANTY

_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
_ISC_NOTICE = "hereby granted, [[provided that the above copyright notice and this permission notice appear in all copies]]. "
_ISC_WARRANTY = (
    " \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(kind: str, version: str) -> list[str]:
    """Notices of a GNU license: short ones, the permission alone, and with the paragraphs after it."""
    name = f"GNU {kind}General Public License"
    texts = []
    for lead in ("This work is licensed", "Licensed", "Released", "Distributed"):
        texts += [f"{lead} under the [[{name}, version {version}]]", f"{lead} under the [[{name} v{version}]]"]
        if kind in ("", "Lesser ", "Affero "):
            short = {"": "GPL", "Lesser ": "LGPL", "Affero ": "AGPL"}[kind]
            texts += [f"{lead} under the [[{short} v{version}]]", f"{lead} under the [[{short}v{version}]]", f"{lead} under the [[{short} version {version}]]"]
            texts += [f"{lead} under the [[{short} {version}]]", f"{lead} under the [[{short} {version}.0]]"]
    thing = "library" if kind in ("Lesser ", "Library ") else "program"
    may = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the "
    by = "as published by the Free Software Foundation"
    later = "(at your option) any later version."
    after = (
        f" This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} "
        f"along with this {thing}"
    )
    ends = (
        ". If not, see <https://www.gnu.org/licenses/>.",
        "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    )
    for text in (
        f"{may}[[{name}]] {by}, either [[version {version} of the License]], or {later}",
        f"{may}[[{name}]] {by}; either [[version {version}, or]] {later}",
        f"{may}[[{name}]] {by}; [[version {version} of the License]].",
        f"{may}[[{name} version {version} as published]] by the Free Software Foundation.",
    ):
        texts += [text, *(text + after + end for end in ends)]
    return texts


def _creative_commons() -> dict[str, list[str]]:
    parts = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    found = {}
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
            names = ["-".join(parts[p] for p in kind.split("-"))]
            names += [n for n in (names[0].replace("NoDerivatives", "NoDerivs"),) if n not in names]
            names += [n.replace("NonCommercial", "Noncommercial").replace("ShareAlike", "Share Alike") for n in names if "ShareAlike" in n]
            texts = [f"{lead} under [[CC {kind} {version}]]" for lead in ("Licensed", "Released", "This work is licensed")]
            region = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            for name in names:
                for lead in ("This work is licensed", "Licensed"):
                    texts.append(f"{lead} under a [[Creative Commons {name} {version}]] {region} License")
                    texts.append(f"{lead} under a [[Creative Commons {name} License {version}]]")
            found[f"CC-{kind}-{version}"] = texts
    return found


TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the [[Apache License, Version 2.0]]",
        "Licensed under the [[Apache License 2.0]]",
        "Licensed under the [[Apache License, Version 2.0]] (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released [[under the MIT License]]",
        "Licensed [[under the MIT License]]",
        _MIT + _MIT_NOTICE,
        _MIT + _MIT_NOTICE + _MIT_WARRANTY,
    ],
    "MIT-0": [_MIT + "permit persons to whom the Software is [[furnished to do so. THE SOFTWARE IS PROVIDED]]" + _MIT_WARRANTY.removeprefix("THE SOFTWARE IS PROVIDED")],
    "X11": [_MIT + _MIT_NOTICE + _MIT_WARRANTY + _X11_NAME],
    "GPL-1.0": _gnu("", "1"),
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "AGPL-3.0": _gnu("Affero ", "3"),
    "LGPL-2.0": [*_gnu("Library ", "2"), *_gnu("Lesser ", "2")],
    "LGPL-2.1": _gnu("Lesser ", "2.1"),
    "LGPL-3.0": _gnu("Lesser ", "3"),
    **_creative_commons(),
    "CC0-1.0": ["Licensed under [[CC0 1.0]]", "Released under [[CC0 1.0]]"],
    "MPL-1.1": [
        "The contents of this file are subject to the [[Mozilla Public License Version 1.1]] (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is "
        "distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language "
        "governing rights and limitations under the License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the [[Mozilla Public License, v. 2.0]]. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    # The conditions without the words that say which BSD license it is: given only where no other is found.
    "BSD": [_BSD, _BSD + _BSD_BINARY],
    "BSD-2-Clause": [_BSD + _BSD_LAST + _BSD_WARRANTY],
    "BSD-3-Clause": [_BSD + _BSD_BINARY + "3. " + _BSD_NAME, _BSD + _BSD_BINARY + "3. " + _BSD_NAME + _BSD_PROVIDED],
    "BSD-4-Clause": [
        _BSD + _BSD_BINARY + _BSD_ADVERTISING + "4. " + _BSD_NAME,
        _BSD + _BSD_BINARY + _BSD_ADVERTISING + "4. " + _BSD_NAME + _BSD_PROVIDED,
    ],
    "ISC": [_ISC + _ISC_NOTICE, _ISC + _ISC_NOTICE + "THE SOFTWARE IS PROVIDED" + _ISC_WARRANTY],
    "0BSD": [_ISC + "[[hereby granted. THE SOFTWARE IS PROVIDED]]" + _ISC_WARRANTY],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
}

# License: file, and phrases of it that tell it from its neighbours.
WHOLE = {
    "Apache-2.0": ("Apache-2.0",),
    "GPL-1.0": ("GPL-1",),
    "GPL-2.0": ("GPL-2",),
    "GPL-3.0": ("GPL-3", "13. Use with the GNU Affero General Public License."),
    "LGPL-2.0": ("LGPL-2", "new versions of the Library General Public License"),
    "LGPL-2.1": ("LGPL-2.1", "new versions of the Lesser General Public License"),
    "LGPL-3.0": ("LGPL-3",),
    "CC0-1.0": ("CC0-1.0",),
    "MPL-1.1": ("MPL-1.1",),
    "MPL-2.0": ("MPL-2.0",),
    "BSL-1.0": ("BSL-1.0",),
    "Unlicense": ("Unlicense",),
    "Artistic-1.0-Perl": ("Artistic",),
    "GFDL-1.2": ("GFDL-1.2",),
    "GFDL-1.3": ("GFDL-1.3", "11. RELICENSING"),
}


def all_templates() -> dict[str, list[str]]:
    """Every license's notices and whole texts."""
    return {name: TEMPLATES.get(name, []) + ([_whole(*WHOLE[name])] if name in WHOLE else []) for name in {**TEMPLATES, **WHOLE}}
