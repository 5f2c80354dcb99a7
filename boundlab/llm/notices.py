"""Wordings of public licence notices, lower case and without punctuation.

These are the standard notices that projects put into their files, not whole
licences: a notice of up to 128 words.
"""

NOTICES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("artistic", "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0 you should have received a copy of the artistic license along with this program"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-nd", "this work is licensed under the creative commons attribution noncommercial noderivatives 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-sa", "this work is licensed under the creative commons attribution noncommercial sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc sa 4 0"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which is available at https www eclipse org legal epl 2 0"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("odbl", "this database is made available under the open database license any rights in individual contents of the database are licensed under the database contents license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at https scripts sil org ofl"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]
