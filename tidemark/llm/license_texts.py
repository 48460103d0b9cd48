"""Known licence texts: fixed values, as published. Copyright lines don't count, as the canonical form has none.

Short licences are below; long ones are in license_files/, copies of Debian's /usr/share/common-licenses and of
packages' copyright files. An id is the licence's, with a suffix "form N" for its other titles and layouts.
"""

from __future__ import annotations

import re
from importlib.resources import files

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{terms}"""
_MIT_TERMS = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""



def _numbered(key: str, texts: list[str]) -> dict[str, str]:
    return {key if n == 1 else f"{key} form {n}": text for n, text in enumerate(dict.fromkeys(texts), 1)}


#: Licence id -> text.
TEXTS = {
    "MIT": f"MIT License\n\n{_MIT_GRANT.format(terms=_MIT_TERMS)}\n\n{_MIT_WARRANTY}",
    "MIT-untitled": f"{_MIT_GRANT.format(terms=_MIT_TERMS)}\n\n{_MIT_WARRANTY}",
    "MIT-0": f"MIT No Attribution\n\n{_MIT_GRANT.format(terms='.')}\n\n{_MIT_WARRANTY}",
    "ISC": f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "ISC-untitled": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "0BSD": f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}",
    "BSD-2-Clause": f"{_BSD_HEAD}{_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_HEAD}{_BSD_NAMES}{_BSD_WARRANTY}",
}

#: Licence id of a short text -> titles it is published under, besides those above.
_TITLES = {
    "MIT": ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "MIT"),
    "MIT-0": ("", "MIT No Attribution License", "MIT-0", "The MIT-0 License", "MIT Zero License"),
    "ISC": ("The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The 2-Clause BSD License", "2-Clause BSD License", "FreeBSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "Revised BSD License", "The 3-Clause BSD License", "3-Clause BSD License", "BSD License", "The BSD License"),
}


def _layouts(text: str) -> list[str]:
    """The text, its items without numbers or in letters, and ISC's grant as it first was."""
    out = [text]
    if re.search(r"(?m)^1\. ", text):
        out += [re.sub(r"(?m)^\d\. ", "", text), re.sub(r"(?m)^\d(?=\. )", lambda m: "_abc"[int(m[0])], text)]
    return out + [x.replace("modify, and/or distribute", "modify, and distribute") for x in out if "and/or distribute" in x]


for _key, _titles in _TITLES.items():
    _body = TEXTS[_key].split("\n\n", 1)[1] if _key in ("MIT", "MIT-0", "ISC") else TEXTS[_key]
    _old = TEXTS[_key].split("\n\n", 1)[0] if _key in ("MIT", "MIT-0", "ISC") else ""
    TEXTS |= _numbered(_key, [TEXTS[_key], *[f"{t}\n\n{x}" for t in (_old, *_titles) for x in _layouts(_body)]])

_FSF = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_FSF_OTHERS = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA")


def _long_forms(text: str) -> list[str]:
    """The text with and without its appendix and its first paragraph (the title), with other addresses and http."""
    body = re.split(r"(?m)^ *END OF TERMS AND CONDITIONS *$", text)[0]
    out = [text] if body == text else [text, body + "END OF TERMS AND CONDITIONS", body]
    out += [x.lstrip().split("\n\n", 1)[1] for x in out if "\n\n" in x.strip()[:100]]
    address = re.compile(r"\s+".join(map(re.escape, _FSF.replace(", USA", " USA").split())))
    out += [address.sub(other, x) for x in out if address.search(x) for other in _FSF_OTHERS]
    return out + [x.replace("https://", "http://") for x in out if "https://" in x]


for _file in sorted(files("tidemark.llm").joinpath("license_files").iterdir(), key=lambda f: f.name):
    TEXTS |= _numbered(_file.name.removesuffix(".txt"), _long_forms(_file.read_text("utf-8")))

#: Licence id -> names that one-line notices give it.
_NAMES = {
    "0BSD": ("0BSD License", "Zero-Clause BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache-2.0 License", "Apache 2.0 License", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "ISC": ("ISC License",),
    "MIT": ("MIT License", "MIT"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
for _id, _name, _versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))):
    for _v in _versions:
        _dotted = _v if "." in _v else f"{_v}.0"
        _NAMES[f"{_id}-{_dotted}"] = (f"{_name}, version {_v}", f"{_name} v{_dotted}", f"{_name} version {_dotted}", f"{_id} version {_v}", f"{_id}v{_v}", f"{_id}-{_dotted}")
for _id, _words in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _v, _where in (("3.0", "Unported"), ("4.0", "International")):
        _NAMES[f"CC-{_id}-{_v}"] = (f"CC {_id} {_v}", f"CC {_id} {_v} License", f"Creative Commons {_words} {_v} License", f"Creative Commons {_words} {_v} {_where} License", f"Creative Commons {_words} {_v} {_where}")
_VERBS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This software is released under")

_FIRST = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}

#: Notice id -> one-line notice that stands for a licence's text.
NOTICES = {k: v for i, names in _NAMES.items() for k, v in _numbered(f"{i} notice", [*filter(None, [_FIRST.get(i)]), *[f"{verb} {the}{name}." for name in names for the in ("", "the ", "a " if i.startswith("CC-") else "the terms of the ") for verb in _VERBS]]).items()}
