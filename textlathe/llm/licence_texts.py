"""Notices and texts of licences, as their publishers give them, that documents are compared with."""

from __future__ import annotations

MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
AS_IS_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
AS_IS_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means."
)
APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
APACHE_OPENING = (
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
    '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. '
    '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.'
)
GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {name}General Public License for more details."
)
GPL_OPENING = (
    "GNU {name}GENERAL PUBLIC LICENSE Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. {place} Everyone is permitted to copy and distribute verbatim copies of this license document, "
    "but changing it is not allowed."
)
GPL_3_PREAMBLE = (
    " Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and "
    "change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."
)
GPL_2_PREAMBLE = (
    " Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free "
    "software--to make sure the software is free for all its users."
)
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
MPL_OPENING = (
    'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. '
    '1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.'
)

#: Notices that a file carries: the licence and the words that name it.
NOTICES = (
    ("AGPL-3.0", GPL_NOTICE.format(name="Affero ", version="3")),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", BSD_GRANT),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", GPL_NOTICE.format(name="", version="2")),
    ("GPL-3.0", GPL_NOTICE.format(name="", version="3")),
    ("ISC", ISC_GRANT),
    ("LGPL-3.0", GPL_NOTICE.format(name="Lesser ", version="3")),
    ("MIT", MIT_GRANT),
    ("MPL-2.0", MPL_NOTICE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", UNLICENSE),
)
#: Texts of licence files that are all there is in them, but for a title and who holds the copyright.
WHOLE_TEXTS = (
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_TWO} {AS_IS_BSD}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_THIRD} {AS_IS_BSD}"),
    ("ISC", f"{ISC_GRANT} {AS_IS_ISC}"),
    ("MIT", f"{MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS_MIT}"),
    ("Unlicense", UNLICENSE),
)
#: What licence files of many pages open with.
OPENINGS = (
    ("AGPL-3.0", GPL_OPENING.format(name="AFFERO ", version="3", date="19 November 2007", year="2007", place="<https://fsf.org/>")),
    ("Apache-2.0", APACHE_OPENING),
    ("GPL-2.0", GPL_OPENING.format(name="", version="2", date="June 1991", year="1989, 1991", place="51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA") + GPL_2_PREAMBLE),
    ("GPL-3.0", GPL_OPENING.format(name="", version="3", date="29 June 2007", year="2007", place="<https://fsf.org/>") + GPL_3_PREAMBLE),
    ("LGPL-3.0", GPL_OPENING.format(name="LESSER ", version="3", date="29 June 2007", year="2007", place="<https://fsf.org/>")),
    ("MPL-2.0", MPL_OPENING),
)

#: Identifiers of SPDX, which also stand after "SPDX-License-Identifier:".
IDENTIFIERS = (
    "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense"
).split()
#: What licences are called in running text.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("AGPL-3.0", "GNU Affero General Public License v3"),
    ("AGPL-3.0", "AGPL v3"),
    ("AGPL-3.0", "AGPLv3"),
    ("Apache-2.0", "Apache License version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache 2.0"),
    ("BSD-2-Clause", "2-clause BSD"),
    ("BSD-2-Clause", "BSD 2-Clause"),
    ("BSD-3-Clause", "3-clause BSD"),
    ("BSD-3-Clause", "BSD 3-Clause"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-2.0", "GNU General Public License v2"),
    ("GPL-2.0", "GPL v2"),
    ("GPL-2.0", "GPLv2"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("GPL-3.0", "GNU General Public License v3"),
    ("GPL-3.0", "GPL v3"),
    ("GPL-3.0", "GPLv3"),
    ("ISC", "ISC License"),
    ("ISC", "License ISC"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-2.1", "LGPL v2.1"),
    ("LGPL-2.1", "LGPLv2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License v3"),
    ("LGPL-3.0", "LGPL v3"),
    ("LGPL-3.0", "LGPLv3"),
    ("MIT", "MIT License"),
    ("MIT", "MIT licence"),
    ("MIT", "License MIT"),
    ("MPL-2.0", "Mozilla Public License version 2.0"),
    ("MPL-2.0", "Mozilla Public License v. 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("Unlicense", "The Unlicense"),
)
#: A name is a notice after one of these words, or if it begins with one.
SAID = frozenset("license licence licensed licenced licensing released distributed available published provided covered governed offered shared under terms spdx".split())
#: It is none after one of these, or before one of NOT_NEXT, which make it another name.
DENIED = frozenset("not never neither nor unlike no previously formerly".split())
NOT_NEXT = frozenset("0 clear".split())
