"""Licence wordings in template markup: fixed values, whole texts first, then the notices and statements that name a licence.

`<<beginOptional>>...<<endOptional>>` may be missing; `<<var;max=N>>` stands for one to N words, `<<var;min=0;max=N>>` for none
to N. Case and everything between words do not matter.
"""

from __future__ import annotations

_COPYRIGHT = "<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;max=16>><<endOptional>> <<beginOptional>>all rights reserved<<endOptional>>"

_MIT = """<<beginOptional>><<beginOptional>>the<<endOptional>> MIT License <<beginOptional>>MIT<<endOptional>><<endOptional>> {copyright}
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=8>> (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
paragraph)<<endOptional>> shall be included in all copies or substantial portions of <<var;max=4>>. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""

_ISC = """<<beginOptional>>ISC License<<endOptional>> {copyright} Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>and/or<<endOptional>>
distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=6>> DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=6>> BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_0BSD = """<<beginOptional>><<beginOptional>>BSD<<endOptional>> Zero Clause <<beginOptional>>BSD<<endOptional>> License<<endOptional>> {copyright} Permission to use, copy, modify, and/or distribute this
software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=6>> DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
<<var;max=6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """<<beginOptional>><<beginOptional>>the<<endOptional>> BSD {clauses} Clause <<var;min=0;max=4>> License<<endOptional>> {copyright} Redistribution and use in source and
binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""

_BSD_NAMES = """<<beginOptional>>3<<endOptional>> Neither the name of <<var;max=12>> nor the names of <<var;max=6>> may be used to endorse or promote products
derived from this software without specific prior written permission."""

_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """<<beginOptional>>the unlicense<<endOptional>> This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE. <<beginOptional>>For more information, please refer to <<var;max=6>><<endOptional>>"""

_ZLIB = """<<beginOptional>>zlib License<<endOptional>> {copyright} This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: <<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
but is not required. <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution."""

_BOOST = """<<beginOptional>>Boost Software License Version 1.0 <<var;min=0;max=4>><<endOptional>> Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce,
display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included
in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;max=4>> except in compliance with the
License. You may obtain a copy of the License at <<var;min=0;max=12>> Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""

_GNU_NOTICE = """<<var;max=6>> is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published
by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. <<var;max=6>> is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. You should have received a copy of the GNU {name}
General Public License along with <<var;max=6>>. If not, <<var;max=16>>."""

_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this <<var;max=2>>, You can obtain one at <<var;max=8>>."""

_UNDER = "<<beginOptional>>terms of the<<endOptional>>"
_CC = "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>>"
_SHORT = "<<beginOptional>>international<<endOptional>>"
_LONG = "creative commons attribution {more} 4 0 <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license"
_GNU = "licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>gnu<<endOptional>> {name} general public license <<beginOptional>>as published by the free software foundation<<endOptional>>"
_LATER = "<<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"


def _gnu(label: str, name: str, versions: tuple[str, ...]) -> list[tuple[str, str]]:
    found = []
    for version in versions:
        point = version.replace(".", " ") + (" <<beginOptional>>0<<endOptional>>" if version.isdigit() else "")
        found.append((f"{label}-{version if '.' in version else version + '.0'}", _GNU_NOTICE.format(name=name, version=point)))
        found.append((f"{label}-{version if '.' in version else version + '.0'}", f"{_GNU.format(name=name)} <<beginOptional>>either<<endOptional>> version {point} {_LATER}"))
    return found


#: Label, then wording.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", _MIT.format(copyright=_COPYRIGHT)),
    ("isc", _ISC.format(copyright=_COPYRIGHT)),
    ("0bsd", _0BSD.format(copyright=_COPYRIGHT)),
    ("bsd-2-clause", f"{_BSD_HEAD.format(clauses=2, copyright=_COPYRIGHT)} {_BSD_TAIL}"),
    ("bsd-3-clause", f"{_BSD_HEAD.format(clauses=3, copyright=_COPYRIGHT)} {_BSD_NAMES} {_BSD_TAIL}"),
    ("unlicense", _UNLICENSE),
    ("zlib", _ZLIB.format(copyright=_COPYRIGHT)),
    ("bsl-1.0", _BOOST),
    ("apache-2.0", _APACHE_NOTICE),
    ("mpl-2.0", _MPL_NOTICE),
    *_gnu("gpl", "", ("2", "3")),
    *_gnu("lgpl", "lesser", ("2.1", "3")),
    *_gnu("agpl", "affero", ("3",)),
    ("mit", f"<<beginOptional>>released<<endOptional>> under the {_UNDER} MIT license"),
    ("apache-2.0", f"licensed under the {_UNDER} apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("mpl-2.0", f"licensed under the {_UNDER} mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"),
    ("cc-by-4.0", f"{_CC} cc by {_SHORT} 4 0"),
    ("cc-by-sa-4.0", f"{_CC} cc by sa {_SHORT} 4 0"),
    ("cc-by-nc-4.0", f"{_CC} cc by nc {_SHORT} 4 0"),
    ("cc-by-nd-4.0", f"{_CC} cc by nd {_SHORT} 4 0"),
    ("cc-by-4.0", _LONG.format(more="")),
    ("cc-by-sa-4.0", _LONG.format(more="sharealike")),
    ("cc-by-nc-4.0", _LONG.format(more="noncommercial")),
    ("cc-by-nd-4.0", _LONG.format(more="noderivatives")),
    ("cc0-1.0", "<<beginOptional>>creative commons<<endOptional>> <<beginOptional>>zero<<endOptional>> cc0 1 0 <<beginOptional>>universal<<endOptional>>"),
    ("notice", "copyright <<beginOptional>>c<<endOptional>> <<var;max=8>> all rights reserved"),
)
