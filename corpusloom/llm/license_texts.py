"""License templates beyond the notices of license_scan: (name, text), and the phrases that tell them apart.

Long texts are files in `licenses`, as the licensors publish them; only the driver reads these.
"""

from __future__ import annotations

from pathlib import Path

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

SHORT_TEXTS = {
    "mit-text": f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "mit-0-text": f"{_GRANT}. {_AS_IS}",
    "isc-text": f"{_USE}, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR}",
    "0bsd-text": f"{_USE}. {_AUTHOR}",
    "bsd-2-clause-text": f"{_BSD} {_BSD_END}",
    "bsd-3-clause-text": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS,
    "gpl-2.0": "This program is free software; " + _GNU.format("General Public", "2"),
    "lgpl-2.1": "This library is free software; " + _GNU.format("Lesser General Public", "2.1"),
    "lgpl-3.0": "This program is free software: " + _GNU.format("Lesser General Public", "3"),
    "agpl-3.0": "This program is free software: " + _GNU.format("Affero General Public", "3"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Phrases that must stand in a match word for word.
KEYS = {
    "mit-notice": ("mit license",),
    "apache-2.0-notice": ("apache license version 2 0",),
    "gpl-3.0-notice": ("gnu general public license version 3",),
    "cc-by-nc-4.0-notice": ("cc by nc 4 0",),
    "gpl": ("gnu general public license", "version 3 of the license"),
    "gpl-2.0": ("gnu general public license", "version 2 of the license"),
    "lgpl-2.1": ("gnu lesser general public license", "version 2 1 of the license"),
    "lgpl-3.0": ("gnu lesser general public license", "version 3 of the license"),
    "agpl-3.0": ("gnu affero general public license", "version 3 of the license"),
    "mpl-2.0": ("mozilla public license v 2 0",),
    "apache-2.0": ("apache license version 2 0",),
    "mit-text": ("subject to the following conditions",),
    "mit-0-text": ("furnished to do so the software is provided",),
    "isc-text": ("hereby granted provided that",),
    "0bsd-text": ("hereby granted the software is provided",),
    "bsd-2-clause-text": ("provided with the distribution this software is provided",),
    "bsd-3-clause-text": ("may be used to endorse or promote products",),
    "Apache-2.0-text": ("apache license version 2 0",),
    "CC0-1.0-text": ("cc0 1 0 universal",),
    "GFDL-1.2-text": ("gnu free documentation license version 1 2",),
    "GFDL-1.3-text": ("gnu free documentation license version 1 3",),
    "GPL-1-text": ("gnu general public license version 1",),
    "GPL-2-text": ("gnu general public license version 2",),
    "GPL-3-text": ("gnu general public license version 3",),
    "LGPL-2-text": ("gnu library general public license version 2",),
    "LGPL-2.1-text": ("gnu lesser general public license version 2 1",),
    "LGPL-3-text": ("gnu lesser general public license version 3",),
    "MPL-1.1-text": ("mozilla public license version 1 1",),
    "MPL-2.0-text": ("mozilla public license version 2 0",),
}

_LEADS = ("licensed under", "released under", "distributed under", "available under", "published under", "provided under", "under the terms of", "SPDX-License-Identifier:")
_CC = [(f"cc-{k}-{v}", (f"CC {k.upper()} {v}", f"Creative Commons {long} {v}")) for k, long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")) for v in ("2.0", "2.5", "3.0", "4.0")]
_GNUS = [(f"{short}-{v}", tuple(x.format(n) for n in ({v, v.removesuffix(".0")}) for x in (f"GNU {long} License, version {{}}", f"{short.upper()}-{{}}", f"{short.upper()}v{{}}", f"GNU {short.upper()} v{{}}", f"GNU {short.upper()} version {{}}"))) for short, long, versions in (("gpl", "General Public", ("2.0", "3.0")), ("lgpl", "Lesser General Public", ("2.1", "3.0")), ("agpl", "Affero General Public", ("3.0",))) for v in versions]
_NAMES = [
    ("mit", ("MIT License", "MIT")), ("bsd", ("BSD License",)), ("bsd-2-clause", ("BSD 2-Clause License", "BSD-2-Clause")), ("bsd-3-clause", ("BSD 3-Clause License", "BSD-3-Clause")),
    ("apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")), ("mpl-2.0", ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0")),
    ("isc", ("ISC License", "ISC")), ("unlicense", ("Unlicense",)), ("zlib", ("zlib License", "Zlib")), ("bsl-1.0", ("Boost Software License, Version 1.0", "BSL-1.0")), ("epl-2.0", ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0")),
    ("cc0-1.0", ("CC0 1.0", "Creative Commons Zero 1.0")), *_CC, *_GNUS,
]


def every(notices: dict[str, str]) -> list[tuple[str, str, tuple[str, ...]]]:
    """(name, text, phrases that must be there): the given templates, then full texts and notices; a notice has its name with '-notice'."""
    files = [(f"{p.stem}-text", p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    long = [(name, text, KEYS.get(name, ())) for name, text in (*notices.items(), *SHORT_TEXTS.items(), *files)]
    return long + [(f"{name}-notice", f"{lead} {the}{form}", (form,)) for name, forms in _NAMES for form in forms for lead in _LEADS for the in ("", "the ", "a ")]
