"""What the licence operator knows: sentences of published licences and the rules over them."""

from __future__ import annotations

# Known licence sentences by identifier, as published.  A star stands for up to twelve words.
SENTENCES = {
    # Apache
    "apache-short": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under the Apache 2.0 License.", "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License, Version 2.0.", "This project is licensed under the Apache 2.0 License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-definition": ['"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'],
    "apache-end": ["END OF TERMS AND CONDITIONS"],
    # MIT, X11, ISC and their kin
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "This project is licensed under the MIT License, see the LICENSE file for details."],
    "mit-title": ["MIT License", "The MIT License (MIT)", "The MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-no-event": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "x11-no-event": ["IN NO EVENT SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "x11-names": ["Except as contained in this notice, the name of * shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from *."],
    "isc-short": ["Released under the ISC License.", "Licensed under the ISC License."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zero-bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-as-is": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "isc-no-event": ["IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    # BSD
    "bsd-short": ["Licensed under the BSD License.", "Released under the BSD License."],
    "bsd2-short": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "bsd3-short": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-endorse": ["Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-as-is": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "bsd-no-event": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    # GNU
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "This project is licensed under the GNU General Public License v3.0."],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "This project is licensed under the GNU General Public License v2.0."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl3-only-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl2-only-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., *."],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl3-copyleft": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "gpl2-designed": ["The licenses for most software are designed to take away your freedom to share and change it."],
    "lgpl3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-see": ["See the GNU Lesser General Public License for more details."],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-incorporates": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-see": ["See the GNU Affero General Public License for more details."],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "agpl-copyleft": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "agpl-short": ["Licensed under the GNU Affero General Public License, version 3."],
    "lgpl-short": ["Licensed under the GNU Lesser General Public License, version 3."],
    "gfdl": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."],
    # Mozilla, Eclipse, Common Development and Distribution, European Union
    "mpl2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "mpl2-short": ["Licensed under the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "mpl2-contributor": ['"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.', '1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "epl2-under": ['THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").'],
    "epl1-title": ["Eclipse Public License - v 1.0"],
    "epl-recipient": ["ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."],
    "epl2-made": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "cddl1-title": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"],
    "cddl1-subject": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'],
    "eupl12": ["Licensed under the EUPL, Version 1.2.", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence);"],
    # Boost, zlib, Artistic, PostgreSQL, NCSA, Microsoft, Python, fonts
    "bsl-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-short": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    "bsl-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-no-event": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "zlib-altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "zlib-notice": ["This notice may not be removed or altered from any source distribution."],
    "artistic2-title": ["The Artistic License 2.0"],
    "artistic2-preamble": ["This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "ncsa-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mspl": ['This license governs use of the accompanying software.'],
    "mspl-title": ["Microsoft Public License (Ms-PL)"],
    "psf2-title": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "ofl-short": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "ofl-title": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    # Public domain and its kin
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "wtfpl-do": ["You just DO WHAT THE FUCK YOU WANT TO."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "To the extent possible under law, * has waived all copyright and related or neighboring rights to *."],
    "cc0-title": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "cc0-short": ["Released under CC0 1.0.", "Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    # Creative Commons
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the Creative Commons Attribution 4.0 International License.", "This work is licensed under CC BY 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under CC BY-NC 4.0."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is licensed under CC BY-ND 4.0."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "This work is licensed under CC BY-NC-SA 4.0."],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "This work is licensed under CC BY-NC-ND 4.0."],
    "cc-by-sa-3": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "cc-by-3": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
}
# Ordered rules, from a sequence of sentence identifiers to a licence; the longest that fits wins.
RULES = (
    (("apache-short", "apache-copy", "apache-as-is", "apache-see"), "Apache-2.0"),
    (("apache-short", "apache-copy"), "Apache-2.0"),
    (("apache-short",), "Apache-2.0"),
    (("apache-title", "apache-terms", "apache-definition", "apache-end"), "Apache-2.0"),
    (("apache-title", "apache-terms", "apache-definition"), "Apache-2.0"),
    (("apache-title", "apache-terms"), "Apache-2.0"),
    (("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-no-event"), "MIT"),
    (("mit-grant", "mit-notice", "mit-as-is", "mit-no-event"), "MIT"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-short",), "MIT"),
    (("mit0-grant", "mit-as-is", "mit-no-event"), "MIT-0"),
    (("mit0-grant", "mit-as-is"), "MIT-0"),
    (("mit-grant", "mit-notice", "mit-as-is", "x11-no-event", "x11-names"), "X11"),
    (("isc-grant", "isc-as-is", "isc-no-event"), "ISC"),
    (("isc-grant",), "ISC"),
    (("isc-short",), "ISC"),
    (("zero-bsd-grant", "isc-as-is", "isc-no-event"), "0BSD"),
    (("zero-bsd-grant",), "0BSD"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-no-event"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-no-event"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd3-short",), "BSD-3-Clause"),
    (("bsd2-short",), "BSD-2-Clause"),
    (("bsd-short",), "BSD"),
    (("gpl-free", "gpl-hope", "gpl-see", "gpl-received"), "GPL-3.0-or-later"),
    (("gpl-free", "gpl-hope", "gpl-see"), "GPL-3.0-or-later"),
    (("gpl-free",), "GPL-3.0-or-later"),
    (("gpl3-only-free", "gpl-hope", "gpl-see", "gpl-received"), "GPL-3.0-only"),
    (("gpl3-only-free", "gpl-hope", "gpl-see"), "GPL-3.0-only"),
    (("gpl3-only-free",), "GPL-3.0-only"),
    (("gpl2-free", "gpl-hope", "gpl-see", "gpl-received"), "GPL-2.0-or-later"),
    (("gpl2-free", "gpl-hope", "gpl-see"), "GPL-2.0-or-later"),
    (("gpl2-free",), "GPL-2.0-or-later"),
    (("gpl2-only-free", "gpl-hope", "gpl-see", "gpl-received"), "GPL-2.0-only"),
    (("gpl2-only-free", "gpl-hope", "gpl-see"), "GPL-2.0-only"),
    (("gpl2-only-free",), "GPL-2.0-only"),
    (("gpl3-title", "gpl-verbatim", "gpl3-copyleft"), "GPL-3.0-only"),
    (("gpl3-title", "gpl-verbatim"), "GPL-3.0-only"),
    (("gpl3-short",), "GPL-3.0-only"),
    (("gpl2-title", "gpl-verbatim", "gpl2-designed"), "GPL-2.0-only"),
    (("gpl2-title", "gpl-verbatim"), "GPL-2.0-only"),
    (("gpl2-short",), "GPL-2.0-only"),
    (("lgpl3-free", "lgpl-hope", "lgpl-see"), "LGPL-3.0-or-later"),
    (("lgpl3-free",), "LGPL-3.0-or-later"),
    (("lgpl21-free", "lgpl-hope", "lgpl-see"), "LGPL-2.1-or-later"),
    (("lgpl21-free",), "LGPL-2.1-or-later"),
    (("lgpl3-title", "gpl-verbatim", "lgpl3-incorporates"), "LGPL-3.0-only"),
    (("lgpl3-title", "gpl-verbatim"), "LGPL-3.0-only"),
    (("lgpl21-title", "gpl-verbatim"), "LGPL-2.1-only"),
    (("lgpl-short",), "LGPL-3.0-only"),
    (("agpl-free", "gpl-hope", "agpl-see"), "AGPL-3.0-or-later"),
    (("agpl-free",), "AGPL-3.0-or-later"),
    (("agpl-title", "gpl-verbatim", "agpl-copyleft"), "AGPL-3.0-only"),
    (("agpl-title", "gpl-verbatim"), "AGPL-3.0-only"),
    (("agpl-short",), "AGPL-3.0-only"),
    (("gfdl",), "GFDL-1.3-or-later"),
    (("mpl2", "mpl2-copy"), "MPL-2.0"),
    (("mpl2",), "MPL-2.0"),
    (("mpl2-title", "mpl2-contributor"), "MPL-2.0"),
    (("mpl2-short",), "MPL-2.0"),
    (("epl2-title", "epl2-under", "epl-recipient"), "EPL-2.0"),
    (("epl2-title",), "EPL-2.0"),
    (("epl2-made",), "EPL-2.0"),
    (("epl1-title",), "EPL-1.0"),
    (("cddl1-title",), "CDDL-1.0"),
    (("cddl1-subject",), "CDDL-1.0"),
    (("eupl12",), "EUPL-1.2"),
    (("bsl-title", "bsl-grant"), "BSL-1.0"),
    (("bsl-grant",), "BSL-1.0"),
    (("bsl-short",), "BSL-1.0"),
    (("zlib-as-is", "zlib-no-event", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"), "Zlib"),
    (("zlib-as-is", "zlib-no-event", "zlib-grant"), "Zlib"),
    (("artistic2-title", "gpl-verbatim", "artistic2-preamble"), "Artistic-2.0"),
    (("artistic2-title",), "Artistic-2.0"),
    (("postgresql-grant",), "PostgreSQL"),
    (("ncsa-grant", "bsd-source", "bsd-binary"), "NCSA"),
    (("ncsa-grant",), "NCSA"),
    (("mspl-title", "mspl"), "MS-PL"),
    (("psf2-title",), "PSF-2.0"),
    (("ofl-short", "ofl-title"), "OFL-1.1"),
    (("ofl-short",), "OFL-1.1"),
    (("ofl-title",), "OFL-1.1"),
    (("unlicense", "unlicense-anyone"), "Unlicense"),
    (("unlicense",), "Unlicense"),
    (("wtfpl-title", "wtfpl-do"), "WTFPL"),
    (("wtfpl-title",), "WTFPL"),
    (("cc0",), "CC0-1.0"),
    (("cc0-title",), "CC0-1.0"),
    (("cc0-short",), "CC0-1.0"),
    (("cc-by",), "CC-BY-4.0"),
    (("cc-by-sa",), "CC-BY-SA-4.0"),
    (("cc-by-nc",), "CC-BY-NC-4.0"),
    (("cc-by-nd",), "CC-BY-ND-4.0"),
    (("cc-by-nc-sa",), "CC-BY-NC-SA-4.0"),
    (("cc-by-nc-nd",), "CC-BY-NC-ND-4.0"),
    (("cc-by-sa-3",), "CC-BY-SA-3.0"),
    (("cc-by-3",), "CC-BY-3.0"),
)
# Every licence of the rules has its short tag too.
TAGS = dict.fromkeys(licence for _, licence in RULES)
SENTENCES |= {f"tag {licence}": [f"SPDX-License-Identifier: {licence}"] for licence in TAGS}
RULES += tuple(((f"tag {licence}",), licence) for licence in TAGS)
