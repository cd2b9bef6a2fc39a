"""Public licences: whole texts of the short ones, notices and names of the long ones.

Fixed values: (label, text, key phrases). A key phrase is a part of the text without which it is not that licence; one of
them must stand in a match, at its place. What differs from copy to copy (years, names) is left out.
"""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = f"{_BSD_HEAD}\n{_BSD_TAIL}"
BSD_3 = f"""{_BSD_HEAD}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
{_BSD_TAIL}"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""

WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_GNU_TAIL = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."

MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"""

CC0 = """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law. You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission."""

TEXTS = (
    ("mit", MIT, ("permission is hereby granted free of charge", "including without limitation the rights to use copy modify merge publish")),
    ("mit", "released under the MIT license", ("mit license",)),
    ("mit", "licensed under the MIT license", ("mit license",)),
    ("bsd", BSD_2, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-3", BSD_3, ("neither the name of the copyright holder nor the names of its contributors", "may be used to endorse or promote products derived from this software")),
    ("bsd", "released under the BSD license", ("bsd license",)),
    ("isc", ISC, ("for any purpose with or without fee is hereby granted", "the author disclaims all warranties with regard to this software")),
    ("zlib", ZLIB, ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such")),
    ("unlicense", UNLICENSE, ("free and unencumbered software", "dedicate any and all copyright interest in the software to the public domain")),
    ("bsl-1.0", BOOST, ("to any person or organization obtaining a copy of the software",)),
    ("wtfpl", WTFPL, ("changing it is allowed as long as the name is changed",)),
    ("apache-2.0", APACHE, ("apache license version 2 0", "except in compliance with the license")),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("gpl-notice", f"{_GNU.format(kind='General', version=2)} {_GNU_TAIL}", ("terms of the gnu general public license",)),
    ("gpl-notice", _GNU.format(kind="General", version=3), ("terms of the gnu general public license",)),
    ("lgpl", f"{_GNU.format(kind='Lesser General', version=3)} {_GNU_TAIL}", ("terms of the gnu lesser general public license",)),
    ("agpl", f"{_GNU.format(kind='Affero General', version=3)} {_GNU_TAIL}", ("terms of the gnu affero general public license",)),
    ("gpl-2.0", "this work is licensed under the GNU General Public License version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the GNU General Public License version 3", ("gnu general public license version 3",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("mpl-2.0", MPL, ("terms of the mozilla public license", "copy of the mpl was not distributed")),
    ("epl", EPL, ("terms of the eclipse public license",)),
    ("cc0", CC0, ("has dedicated the work to the public domain by waiving",)),
    ("cc0", "licensed under CC0 1.0 Universal", ("cc0",)),
    ("public-domain", "this work is dedicated to the public domain", ("dedicated to the public domain",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by", "this work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
)


_SPDX = (("mit", "MIT"), ("apache-2.0", "Apache-2.0"), ("bsd", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("isc", "ISC"), ("zlib", "Zlib"), ("unlicense", "Unlicense"), ("bsl-1.0", "BSL-1.0"), ("mpl-2.0", "MPL-2.0"), ("epl-2.0", "EPL-2.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3.0", "LGPL-3.0"), ("agpl-3.0", "AGPL-3.0"), ("cc0-1.0", "CC0-1.0"), ("cc-by-4.0", "CC-BY-4.0"), ("cc-by-sa-4.0", "CC-BY-SA-4.0"), ("cc-by-nc-4.0", "CC-BY-NC-4.0"))
_CREATIVE = (("cc-by", "Attribution"), ("cc-by-sa", "Attribution-ShareAlike"), ("cc-by-nc", "Attribution-NonCommercial"), ("cc-by-nd", "Attribution-NoDerivatives"), ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
_GNU = (("gpl", "GNU General Public License", ("2", "3")), ("lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("agpl", "GNU Affero General Public License", ("3",)))


def _versions(name: str, version: str) -> tuple[str, ...]:
    """How a name and its version are written."""
    return tuple(f"{name}{between}{version}" for between in (" v", " v ", " version ", ", version ", " "))


#: Names and identifiers with their versions: (label, wordings). Each is looked for word by word.
NAMES = (
    *((label, (f"SPDX-License-Identifier: {name}",)) for label, name in _SPDX),
    *((f"{label}-{v}", (f"Creative Commons {name} {v}", f"Creative Commons {name} License {v}", f"CC {label[3:]} {v}")) for label, name in _CREATIVE for v in ("3.0", "4.0")),
    *((f"{label}-{v if '.' in v else f'{v}.0'}", _versions(name, v)) for label, name, versions in _GNU for v in versions),
    ("apache-2.0", (*_versions("Apache License", "2.0"), "Apache 2.0 License")),
    ("mpl-2.0", _versions("Mozilla Public License", "2.0")),
    ("epl-2.0", _versions("Eclipse Public License", "2.0")),
    ("bsd", ("BSD 2-Clause License", "BSD-2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("bsd-3", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("cc0-1.0", ("CC0 1.0 Universal", "CC0 Public Domain Dedication")),
)
