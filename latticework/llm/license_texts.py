"""Public licence notices and texts, from which the sentence rules are made."""

# Each licence's notice or text, as published. A family's notices differ in name and version alone.
_GPL = "This program is free software{stop} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{stop2} either version {version} of the License, or (at your option) any later version."
_GPL_ONLY = "This program is free software{stop} you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the Free Software Foundation."
_HOPE = "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
GNU = {
    "GPL": "GNU General Public License",
    "LGPL": "GNU Lesser General Public License",
    "AGPL": "GNU Affero General Public License",
}
GNU_VERSIONS = (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"))

_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_OLD_NAME = "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE {holders} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE {liable} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_MIT_LIABLE = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{kept}."
_ISC_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'

# Licence and text, the more telling first; all sentences of a text must follow one another.
NOTICES = (
    ("MIT", f"{_MIT_GRANT} {_MIT_KEEP} {_AS_IS} {_MIT_LIABLE}"),
    ("MIT-0", f"{_MIT_GRANT.removesuffix(', subject to the following conditions:')}. {_AS_IS}"),
    ("BSD-4-Clause", f"{_BSD_HEAD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_OLD_NAME}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAME} {_BSD_DISCLAIMER.format(holders='COPYRIGHT HOLDERS AND CONTRIBUTORS', liable='COPYRIGHT HOLDER OR CONTRIBUTORS')}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_DISCLAIMER.format(holders='COPYRIGHT HOLDERS AND CONTRIBUTORS', liable='COPYRIGHT HOLDER OR CONTRIBUTORS')}"),
    ("BSD-3-Clause", f"{_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAME}"),
    ("BSD-2-Clause", f"{_BSD_SOURCE} {_BSD_BINARY}"),
    ("ISC", f"{_ISC.format(kept=_ISC_KEPT)} {_ISC_AS_IS}"),
    ("0BSD", f"{_ISC.format(kept='')} {_ISC_AS_IS}"),
    *(
        (f"{family}-{version if '.' in version else version + '.0'}-or-later", f"{_GPL.format(name=GNU[family], version=version, stop=stop, stop2=stop2)} {_HOPE.format(thing='program', name=GNU[family])}")
        for family, version in GNU_VERSIONS
        for stop, stop2 in ((";", ";"), (":", ","), (";", ","))
    ),
    *(
        (f"{family}-{version if '.' in version else version + '.0'}-or-later", _GPL.format(name=GNU[family], version=version, stop=stop, stop2=stop2).replace("This program", "This library"))
        for family, version in GNU_VERSIONS
        if family == "LGPL"
        for stop, stop2 in ((";", ";"), (":", ","))
    ),
    *((f"{family}-{version if '.' in version else version + '.0'}-or-later", _GPL.format(name=GNU[family], version=version, stop=stop, stop2=stop2)) for family, version in GNU_VERSIONS for stop, stop2 in ((";", ";"), (":", ","), (";", ","))),
    *((f"{family}-{version if '.' in version else version + '.0'}-only", _GPL_ONLY.format(name=GNU[family], version=version, stop=stop)) for family, version in GNU_VERSIONS for stop in (";", ":")),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", '"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.'),
    ("GPL-2.0-only", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0-only", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1-only", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("LGPL-3.0-only", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0-only", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("EPL-2.0", 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("MIT", _MIT_GRANT),
    ("ISC", _ISC.format(kept=_ISC_KEPT)),
    ("0BSD", _ISC.format(kept="")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0-or-later", "Licensed under the GNU GPL version 2 or later."),
    ("GPL-2.0-or-later", "GNU GPL version 2 or later"),
    ("GPL-3.0-or-later", "GNU GPL version 3 or later"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Licensed under the BSD License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
)

# Identifiers of the public list that stand behind "SPDX-License-Identifier:".
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "WTFPL",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0",
)
SPDX_MARK = "SPDX-License-Identifier:"
