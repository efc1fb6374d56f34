"""Wording of the licence templates (operator 2).

``<<beginOptional>> ... <<endOptional>>`` may be left out, ``<<var;min=a;max=b>>`` stands for a to b words of any kind,
``<<var;match=x|y>>`` for one of the wordings listed. Case and punctuation don't matter.
"""

from __future__ import annotations

# Public licence texts and notices, word for word.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
<<beginOptional>>and associated documentation files<<endOptional>> (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<var;match=noninfringement|non infringement>>. IN NO
EVENT SHALL <<var;min=1;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
<<beginOptional>><<var;match=1|a>><<endOptional>> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.
<<beginOptional>><<var;match=2|b>><<endOptional>> Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
BSD_ENDORSEMENT = """<<beginOptional>><<var;match=3|c>><<endOptional>> Neither the name of <<var;min=1;max=12>> nor the names of
<<var;match=its|the|their>> contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;min=1;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL <<var;min=1;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

ISC_TEXT = """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;min=1;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;min=1;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will
<<var;min=1;max=8>> be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an <<var;match=acknowledgment|acknowledgement>> in the product
documentation would be appreciated but is not required.
<<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software.
<<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at <<var;match=http|https>>
<<beginOptional>>www<<endOptional>> apache org licenses LICENSE 2 0 <<beginOptional>><<var;match=html|txt>><<endOptional>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at <<var;match=http|https>> mozilla org MPL 2 0"""

GNU_NOTICE = """free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the
GNU {kind} Public License as published by the Free Software Foundation{version}.
<<var;min=1;max=8>> <<var;match=is|are>> distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for
more details."""
GNU_LATER = ", either version {number} of the License, or (at your option) any later version"
GNU_ONLY = ", version {number} <<beginOptional>>of the License<<endOptional>>"
GNU_KINDS = (("gpl", "General", ("2", "3")), ("lgpl", "Lesser General", ("2.1", "3")), ("agpl", "Affero General", ("3",)))

CC_PARTS = {
    "nc": "<<var;match=noncommercial|non commercial>>",
    "sa": "<<var;match=sharealike|share alike>>",
    "nd": "<<var;match=noderivatives|noderivs|no derivatives|no derivs>>",
}
CC_LICENCES = ((), ("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd"))
CC_NUMBER = "<<beginOptional>><<beginOptional>>version<<endOptional>> <<var;match=1 0|2 0|2 1|2 5|3 0|4 0>><<endOptional>>"
CC_TAIL = f"{CC_NUMBER} <<beginOptional>><<var;match=international|unported|generic>><<endOptional>> <<beginOptional>>public<<endOptional>> <<var;match=license|licence>>"

NAMES = (
    ("gpl-2.0", "gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"),
    ("gpl-3.0", "gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("cc0", "cc0 <<beginOptional>>1 0<<endOptional>> universal"),
    ("bsd", "bsd <<beginOptional>><<var;match=2 clause|3 clause|4 clause|two clause|three clause|four clause|new|modified|revised|simplified|original>><<endOptional>> <<var;match=license|licence>>"),
    ("mpl-2.0", "mozilla public license <<beginOptional>><<var;match=v|version>><<endOptional>> 2 0"),
    ("spdx", "spdx license identifier <<var;min=1;max=1>>"),
)


def names() -> list[tuple[str, str]]:
    """``(label, template)`` of names that a text may mention."""
    cc_names = [("-".join(("cc-by", *p)), " ".join(("creative commons attribution", *(CC_PARTS[x] for x in p), CC_TAIL))) for p in CC_LICENCES]
    cc_codes = [("-".join(("cc-by", *p)), " ".join(("cc by", *p, CC_NUMBER))) for p in CC_LICENCES if p]
    return [*NAMES, *cc_names, *cc_codes]


def texts() -> list[tuple[str, str]]:
    """``(label, template)`` of whole licence texts and notices."""
    gnu = [
        (f"{label}-{number if '.' in number else number + '.0'}-{ending}", GNU_NOTICE.format(kind=kind, version=version.format(number=number)))
        for label, kind, numbers in GNU_KINDS
        for number in numbers
        for ending, version in (("or-later", GNU_LATER), ("only", GNU_ONLY))
    ]
    return [
        ("mit", MIT_GRANT),
        ("bsd-2-clause", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
        ("bsd-3-clause", f"{BSD_CONDITIONS} {BSD_ENDORSEMENT} {BSD_DISCLAIMER}"),
        ("isc", ISC_TEXT),
        ("zlib", ZLIB_TEXT),
        ("apache-2.0", APACHE_NOTICE),
        ("mpl-2.0", MPL_NOTICE),
        *gnu,
    ]
