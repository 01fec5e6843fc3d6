"""Published codes of the families of hundreds of codes, in order of id."""

# Fixed values.
TAG36H10 = """
1a42f9469 21a48c08d 26dfdbc5d 2d19b78fb 31c5557df 3f2b3d349 3e6d4a7a5 43d6dfb6d 5688d2aff 54663b474 67fd759e4
73b196d82 7de71c630 8492722d4 835407afa 893a6fe16 95668d348 9c20e37a4 a19bb676c ad1355c1b b2ab4ac53 b14f27095
bef6b014d c9ecbadc7 e1996a6bd edc588fcb f26d9d7a1 35e79c1a 1644f74a8 1bfda85e0 20573db2a 27614bfd6 2daf26b72
332930a98 3176c5674 3892ad2d0 3fd4d26ac 4b88a1fca 555b6b579 6103880d7 6045e58fb 6dedf28a3 72766f249 7e4a0c77f
973ba8e61 965fd5285 9d99bd6a9 a221264e6 a1455fcca a7cb3193e aead44d92 ad50ac954 b2f0bb19c cba043aa2 d73d7f6b4
d6d189310 f41278885 1c45306af 222b4420b 2d70ceeb1 392cb439f 45d1179ee 57a79d05c 62bc91dd6 73ca773c0 8b3da6eb0
9c5a521c7 a812a1881 adeab4859 b3402b213 b9171667f f5ac6918c 549b1cfc b2744a58 ae12ceb4 2f8aaab94 38db1c43b
4be190989 51bef9565 505a8d1c3 575ce25bf 68ac14eb1 6fd1bca45 854752994 9e96b442a afb308f74 cd9c8ca44 d23c9b28e
d07277423 e8b3a6959 f44bc546f 10e4aa7f3 29971cc68 62d7b0b94 8c22aac77 8b46d70d3 a43373b0d e2efd2c74 f5f4587e6
1b82bfa0 642bef7a 1e576f881 2a290cda7 3b1ae80b1 53b9317e3 5833ac709 5f25d3ff5 648fcef3d 68d6350d6 8064a4da6
92b76e736 9157102b0 9eef0de60 b098e9306 b63e94718 c1241e99b eab42b39f fca2a422d 7f86a4b 124962550 1fe977988
300a8b4c4 76c2b21a1 932f76619 9994e9b51 a634fcb8b b6d92c074 bcbf53858 c0c3a0d7e 1c31a9c3 d5a694d5 12f2fc41d
5a342598a 6466af138 81eb68f22 98e885eb6 ab594f405 b19f201a1 d44832643 fdc915802 ee4f05dc 3043aa2a6 3765d7a9a
5468500ab 59d38dc6b 60b5e288f 9539ba6df 9a93219d2 ad81ab160 abe7d650c beb8dd89e bd5432e10 9aafb509 14f535a9b
202956e9d 3d64508f8 5babe994e 6d1c1e752 94cb57d7b 9a45c8c11 a7f4dd4c9 d6ab9426b da6766828 f1608f9bc 16ad49fb6
6da68e61f 6ce0e03bb a0404d752 e066e102f 2f9d00546 39878a9e4 49521229c 8a70b85a9 96ecdad9d 9b5300ed7 d08e19cd0
e1dbbf0a6 ef012435c 6ecd2fc10 749a519f4 91b715e4c 90f17dae8 975d0ae16 9ced1f6de ba3660c0b d1b1c9d9d d77fa492b
de0bdcdc7 e2472e389 39ee6b70e 7a8ad48b3 b4ee1682e bb8a7ec82 7cd0404d 11d68ecc7 46cbd039d 4b634dd1a 63c6d44e0
981a82ea0 a93f25d5f a8795d9fb b5d3c69a3 f56912854 1f86096b4 1ee865210 24bf5c67c 37a5d0bee 3c2fcd384 5324bc851
5886a7099 b72fa2c2c fc92eb5b5 422e4a0c6 59b17b310 8e7d2e941 943f50c2d 93db38889 d3c56115c ec3097940 f0c8e4c64
15a1a2b44 31885e859 3c77ec56f 665489b09 ac8831e70 b0559325e d9d4e401b 1618bca4b 6cd54c849 717d5b003 acb7e0f3d
db2c90514 edb75ab84 2d2d82857 95fb613c6 9c1f187c8 b1521d0f9 f252b178d 3fe0f8640 5ca93c171 9dad88605 b32a795d4
d0273d2e4 d7034b6d8 21d211a8b 32f7b66d5 97f46e061 a3a80d947 af24f7511 17760c682 2f17d53f8 5768d8553 5ccac399b
b363443b6 86e868835 d1f31c586 e3c1f8c18 dfb29b8f1 12545997c 3c9b87c9c 650afceda 7cc5d2d4d e97f2c6b4 bcf094d17
c2b6fd1b3 55b7539e1 6563c3099 6cbcaa475 711ebf8bf beacf0872 152bf7dd3 2d9e666a9 8aadf624c ae04840c3 b89fceccb
391534881 6d3b626f3 b8cd3f384 56e622ea0 72da9effc 9d9dc3195 9b5bab5bb a2255635f b3d6b2a41 e1e78a0ca 6f166d850
6ed013c3c 974124e7a b9c237103 12a55c948 6e6e02db3 bb970b4ae cb5e92956 24a8a8519 5e4e6a504 cce402a5b ead45ac6b
b7e065329 2c9b38934 550a5f272 9af15026b c43acbba9 3c4f2ed0 5a6df5a79 acf8a733e e05408ed3 60787293b 89e95533f
dcb673abc e0ea10fda efa4f932e 45e988b2b 5d2c11c5e b84be5c13 50629a003 5e11c1dd3 12111629f 2365f3381 4cf5d41c0
8d957e5b5 25b88ce2c 41ec563d3 c3884919f 4ffd91f28 d6211be2e 2c6c33e2b 9b062517d 9a605d5d1 c93615ffb 587aa508
ae741eba5 4b232ba75 9d68187b1 a253c3b79 bae55c0a6 d0eaa3172 c0c2dbd49 d1d37d23f e952ecf4f a51239d5e f6e416099
da4923cf8 55cd5bbbf 67fad4a0d 6f802d5ab 4c90df6ab cc0aad0e1 745207f2b b516ad892 8da9ca7d8 ba7517799 b13811fcd
328436ca 5965ad68f e6b65823f 951a1abf3 95cce7616 ca003fe57 d5ee5d32b 2d6d58f8e bee25c778 21cac7ed2 7b982415f
237a92d3e 65c2a898a 2a67c67d0 492c37445 e66713585 adb041611 9b5ed4c88 f2f751a83 5a5db231 8478d5037 5e2954c13
d8597d1d 537116e24 7ce063461 a79a20302 b8016f46a ebeb44bdc 206e7cff7 d2870a69 4e21e723a 6a59590e7 a522a2e9b
c2ec8f44f 3e51273c 56bab7c9b b3a92fa7e f4a993d4b 8b80884b7 8a5339f30 690c7389d 9f34cb283 cd0febc20 f579a2a82
3ba18373f 68fddad38 7ca529286 df93cd25b 7d18313a9 febd825c0 898d72da2 c2d8c5ade 60b797eea 7281731bd b48a4940a
d7e28a20d 6d0aac8e 2f418d6e8 45ce7d55f bb3415aa6 f592d643d c556e7e9 dede56c4e 75f63628 778f69c5b b0add7ab7
d86f0b737 6d3092589 776618a1b ecec99b8c 38a56d5b3 e0cb464d1 b9385f3a ba42a64f5 938bb73f3 a7691cb01 86a986dad
447ed963b b6bcab900 a348c9079 71812b90b be867b1a9 7807672ae f52c97520 5f6dabb7 1321e1472 e44ab0b16 31b1b920f
e7a916c37 ec3a095dd e1cc9b481 46209b37b 47f0aa439 d7b31bef 52db78a32 ed3b35ea8 5b1f58572 acf866c7d fa2be6544
774737a28 bcf8fe9b1 fdfc4ac80 a0aef3457 5d93f4f4a a314ac7fa b52221849 b5d908dac ec20c9ce2 da5563b12 57257c59b
ef0e8f782 f9d2b3dc4 ab8097620 b99a08aca 64fe5b8b 19255e746 aab6d88b0 e011adc1b 3214f657c 93f917b4 91f0c7859
bcd3a5171 afd4cb29 8787d5924 24f3a8b55 2ae32d017 67af72a45 8fe87d42a 902c5df3f 2f2500693 868a4733c 5dd4c95d9
97210f5f2 23f0de89f 84ce8a4b5 34eb80e3d 532c70dec 13b90cb54 c3dfe6cb7 8b03d0bad 90bacd3e5 afa0bc824 a38fe08f8
fa758ea36 fe0862d3c 1ace4f7ed e04bac135 63e99b95a b010d68e1 ce9352b2b 82838db6f d3bf04d59 c9df5aec3 a4e8aafee
6b1db1459 6ba3217d0 e5c73549c 37c2679df 732d69874 73ce98c9e 4cc0f5c5e 8f1b8c73 ef1b22865 6f5eb759 1476bea11
78ba48850 74ac468d5 8ed2a2869 a0d4f4fcd 2401bcfac af4852356 e49487115 678ebe495 3afec50b5 ff853144e ca35def53
87328bda4 d258703b5 71152a781 4dd323e43 4812c5a59 57bd1d082 456266e15 6b9fccad6 4abe3b07b baf59cfce 56d6932fc
fd158446c 363f31ca6 93c9eecce 33930d57f 62c9dcfbb 6f52475c4 950d51d55 95c430b37 7424acdf9 5e59f504f 7abe9fe84
1462e4fb3 5b346387f adcf80432 dbcf4c50e 213274059 7d0da7a11 d9c5de950 334edcf91 eaadbf8b8 4fd450926 9a8af56b0
28b062348 86bd1c31d d15dd6c2 8cc9d14c6 d0b9038c4 b445f90b9 c3378c977 197aa5976 f5879d3e2 2ec330e97 4bcab4ba7
185b91b99 9a64ecebf e8b66c585 5e1e848ec a24ca255b 6a0d7dfc7 770e1711a 7e34402b4 525ceff8c 89a56e0c9 ee1401ffc
b13cfa633 327aa9b9a 77383d86d eb6d7283e 4ba294b54 26c84d5d9 1c2c5adc0 694e6ec3c f3064d10 6b7c9d416 d7d74bd89
e11232372 4d84369e0 f7de40249 b64950611 a0724a19b 688eef9ab 3c7a3a2ea 49cd79585 6c35bff78 456a31970 4205eb8ec
2717c22e3 763d127fb 865548e6f 4f1dcc597 279dcfca4 aad1f2e05 6437570c6 d68b74cd9 ec82e7216 4223b2229 9c12a8582
c073eb63d 68b779e29 61157ce5f 50f6ebec2 35f4e4b1c f909c56d6 9c4b78474 b8160eb1e 5e3d256f8 21919b529 d4c7b6226
5190049a8 ad869eab6 a10b3759a 917560e43 2c5d651d7 eb2c8e47c bc131902d 7e883469b 91d991bfe 20c3a7704 2b3b53f8f
8978b2c6a 91138b228 529f08e2c 979342793 98137dcc3 3a9c6e139 f898abd5e ce2585f36 968312f45 2994a6ec2 ca6685871
a3af94337 3f628d34 1e9617f6c a34ed1a9c 2c22028b4 fdeb13f3a 2d85e3ac 957491696 ac42bab89 e3753d50f b712a307a
8b7c1c2ca 8893cb8f8 5abc4467f 5f1aa96c0 b7dcde504 c3cd9ca20 af48c055 f4e10477b 12b45078c 10af764c6 23d8b32d5
36f1e9c47 e847bd756 4c3b4e455 64d42e688 cf5218b7a cdc1605e4 6250bba26 be6c4770a 982331a23 dfd090dca 506bc18d5
109d7375c 680ca4a7e a6e1c91e1 688f44350 ad470ae05 f3ff0a79e 326f26fbe 4105901be 32ed82cd9 9916c638 1d0025ed6
4aeaec114 98af27931 968f79b3b ed4b906d5 61ae9b2e4 59b82a3f5 550eb833b 17b69fd4b 73d569e02 63dba43f8 f6cb4cb8a
d6258181b e86109784 fa5a660ea 4f9815064 75d8db35d 546f94888 58df2d00a 6a779d19b ea1b4e76b 14870eef0 55429f855
e86b71b9f d333c2d43 42733ecd4 d16ba12ef 3b69c3d5c 4a5c07666 a84634048 21a2c4b26 573be1892 730bd1d40 eed055d81
7e815e7a6 8ab11c883 50283e7d2 c8a795b85 47a229dc5 12b9e108c caa2034db a62f9ae47 93979dcfa 5fb8fd985 25bf32ccb
7ae9a5ee5 b10665d2e ed0c2b0e6 2c72c25fd d74f444d2 9b0db80cb 55c8e43de d77253912 84cfd9ea0 1615ba8c5 503884d62
fc53328a8 f547a6153 ca97160cf 95e440434 6fa4c125d a420cfe45 af8147dfb 12e90ddea f14c3cb5e 966579d6a 4447c94d0
32336acea c75d077df b7e72837e 51d24ed1e 93fb67f5c 85cedc1b2 3ca6c5d2b 32269be93 120ed410c fe115d3d4 a045ed79
83e2846de 4e7a34f3b 5078cae37 c831aa1f0 79de6b9b6 8e39b1ad2 66bdb37a5 4a79f5da7 cd9693b30 dc69a07a 8649a002f
932887d37 3926b6a74 c5d4f8ff8 ea290f911 360e344e9 7fa9e8a19 b1d0c16c3 1bbe55ddc 825cdaea9 4f67f00f d3df43a25
b07b349a2 716a39611 aa0fc66b7 f928fca14 697c299d3 6dea5d945 38cee4ea7 4e67ea7b6 24deb4062 e4428a670 8fdb1ad13
318ff0e1c 8c148b5d dbf90b839 3ea5b027 42b077ba9 b528450e0 a1256cbfd 4798a8e57 1fdc0d38f 146329edc fa0f94b03
56c6f0e19 6db661a7 681addf27 d1eded30 765c3d6e7 1ba6ae5ad 5e0b49af4 33176fa1c 64ca46a3a 389363b6f 8cc072db9
b25f03d8f 56aa81ab1 2b1c37b54 ac1c3279d 669af74ed 64816db93 254f44a17 c1f5fc290 ebca3a222 20e75e68b d3bb4dfc2
8d9167a74 b6de37939 f7a9a93d6 9aab08164 6d186ddfc 4d3e529c a53e2a5c4 d5e40b964 9a1d76463 7ad6a8ecc 30b0c9279
351e5b489 bba967fe0 ab3d8bf17 16c42b17a 9744fae63 77a3f2d39 83c0190ac 8d016cba0 5eb9f1e35 6349c2c93 f5a15e641
7a5bc8c86 65b6b9834 b756618a7 d297dc208 3d6cfca2a c26e4a930 3afd2df57 7f990decd 6665a2f43 345d16f4f 322e392bd
567baa5de 4a6412121 a102338a6 b130fd768 72a30a317 e4b71cd71 ad4b2ceeb 1da4e11cf d5df39b45 81622faa8 98f38af5c
25397c292 2cfcdb0d7 d24542679 4f04f5f4 254842f2c c6fce4a81 1518648bf 29ead8e85 dc1435a6b c8ebc91af bcc94c093
8285d6a81 5b5cca263 5279a4fd 8c7dc69a7 963e0b3fc e38519cb6 e84af68a5 d20ee188d 74fdc8660 56f95f633 f5d2233bf
ecb3c9815 c21a3cee6 1558f2f83 8ea10ea50 7ededa109 4d4c5e25d 130e15fa7 64c873cc7 35a0225a3 d37aefb27 b441d8903
2339f650b c52d79fa9 a28badc40 e2b99967c 8726656b3 124e07029 8582b1dab 4eb90cbee bff16b8ac a408251fd 4feccced5
edda7bf1c 55a0d37b2 dd9dc90e a537c9ad8 8b007aeb4 6e17fbab4 d03559e3 66fb4aaac d06449a6b 528bb1818 48f0d8bae
834d540b7 23d5d9ab9 1a13b04d1 bd30cc9af e392c0fb4 fd5d4e8bd cbc646d45 348db96b7 e32e54c5f 62446b63f ea47a2c4d
8d4d99969 d01d6d0d2 1862cef24 ed64fe4ba d48b40fec 30aa27a14 8b2fcfdce 943824f9a bab9f8d09 3204c129f 823a36283
5a0b07693 437949450 4ad8ca4c5 ec979f418 e4ed18627 8cd5d978d 5b33248f0 bf5ac9f64 bd427f795 d19d39539 9f4a46c35
532019548 b0ebce22c b91133fbc 6f1983636 8f898fed7 e642bf2cc a8841dfe9 c6b879b48 7ad82cc2e 651977fc1 4dcf4f025
c94950e6c 2595c6edd d4490ebe6 4105ad270 903d8c8ef 62531ad0b 1c1fd55b3 d27d4ced8 dc62f305b 1e2557e49 495c28ced
9c279d9db 52aa6cef5 7ea533ab1 d7d49e37b e8c5c7424 8137f4da1 ae13670b3 de97bd57 759a6643 d646248df f5f13b6a3
d12b2ecad 205cccbb8 fe6a5b5f2 d1995e567 91d0f2174 360e9ebef d304c9653 7eb43d360 9b24edb22 5aeb87d49 73a745811
e1fd08936 33eeb68a9 6367edc20 36fd414d2 2e6722e78 6c7a9c15e 2330d46f7 b6bc7a6e8 43eb954aa 5eadcf50 63e43b4ea
351ca1f1 8b5682648 c28f03f9a 636bfe005 4ca1054e5 440ed66c9 6e60f6fbc 6d94e25ee adfe9ec25 f0cb53616 cb19d69aa
ff898685e 66ea208d6 5dadebaf0 f3f7afea5 a96739522 39a0ef88e 626acbb6e ce0e42f8d 883ae2d8f 619bd4ce7 be466b665
79e154eae 73e2a0a7a 5ec94e92c 898bc6465 abce956eb 2b21e8995 86364e87d d58212c13 8b8c39e93 a1546c8b 8abbe32b5
e8a4a2512 ad5ee178b 69cc1e886 5bc2f8d35 1bbcd0982 1fd969b1a ae9e4251b 9afc001ad 69e9d82f9 92f852ed7 adb6d7fe1
67b91999d fa2600b99 d6735277e f836268ed b7911c708 13427930e f24a44da1 ed2f760e0 920508584 9f1b07e2b 32c15b482
ffcd64b43 a055b6498 b2a107a8b 191147253 9c214bb01 8bb616abd 1ef7dea4a 9dd6d225d 95563112c 1e4d0569 f21a51b18
686d2a5eb 32032674a c3d902590 856c92019 58ebdcd91 df2c7f9ae 89d852225 862c4110d dc7df8185 c16e1da36 5a6749140
e94d9865 32ec4b2fe c80777c94 6869a7d57 8de18dc8e c98cc7379 79a6fa3a2 8b854287d 55bcd493b f3ddb56ec d15ec6405
316f82362 39676e2a1 4044e831a 8444cf83b 64658814c d7ad48a68 d5eb72583 e11057b5d b7e3cd622 a6a2f9c78 a5924afe8
40a92e9ba 367a3950f 8dee1ebe9 52b717d05 9a5691e7d d454d2e0f fd8b299e9 b2b1b84c2 4eacf400b 81eb4687e 5cd851fa7
1c285ea35 8ac9fdc95 1b612a6c3 94f92a63a 7debaf7c8 8cbcb7d94 e439689ea 932e63d2 f3f641704 1acb5259e 321ea6e39
61c65c02f 4282e42f2 1dd4ff338 d91e27631 d93927fce 4d40d6ae7 5bbfd1359 88bd393fe 2535b3fd7 b705488d3 9aa688843
9fa55ccf0 2cf10ca5 8235e2861 2610f1f02 b203fbac1 e05f02f3c b0d0e50ad 244eee955 4c5beb90d 13343b3c4 21bf9a392
be95ecb69 bc65857e2 8185173f4 c3f6d059d 35c94e74a f72a083a3 5b36eab8f aa28606bb 447d407bd d47eafc61 4e4dd872f
abd276950 b999bc572 8e0c5cee3 9fd2442d0 bcb568051 b87a1635b b3557c1e5 ce9b07f46 b6dfcfd2 28a540e7b bb04666c4
b7baf38c6 c37168124 ca3c9589d 3529b99c0 e8afab685 bdc566027 3f1ded61b ce9930acd 8aa447db 77a696e73 eb44d17b
c5d9c164d 1f98d7237 56a327041 e9ecd1e58 c2e0c7f4 abf4a1a5e 9395c523e d014134fa 5fbd62cad b247b4af6 413f6fb3b
61c6ea7c4 8015ac6a5 baf0e3dd ba1215e4a b01a9b92e c1516251f 1d0eeda9 cf17f566f 3203947b3 7c92be543 c320f34b8
6b1ff7e93 29d39ef02 eda7b1139 cca47d853 7ad24144d 7b082f234 a6ec32320 cf89eda25 b64064998 fa2314616 d21789ac2
d3c8d0f5d 6bac87d8d 1ff1311bd 2a1584b86 b23dc8745 eda5fcd76 a7a9261d0 512745cf6 2fc13fa8b e733958d3 a057fc27d
b4ffd8bbc 2abff4fb6 1d148a214 d3c3c41fb cf542a81 ee518b8db 5d97028fa dd153679 d8e1610b5 575122bab 90fec0a7
5aa2ee7de 116ae8273 16991092e 3ab370aa5 3f0c514e6 340ce20ad d1cbbebb8 aff5b363d 2f31fb255 5b7e53a8a 58d91de7c
6fdf2521f 80d755cb9 cf8c9903b ab7ef0c7 3c61bf489 fbfd14815 baa647e90 daf22defe 1a54cfe57 54d061818 158deb36d
a7955893a 409b1960b 21cfed67e b478f7f56 2ff42f95d 48a06d3ec 170957703 3925ece98 d929cec5b aa5813ee5 9fb913a1e
465854b47 8ac8a7343 84451853b 49987e033 75cd03c35 cf326e2c1 ed14fdb95 31a390e60 a1959d956 1985d18b3 b6b8bb85
dc3fa4c95 3645fcf45 6c2146e60 8bdeaf7d6 5d0d268cf 8df1d5b62 77506eed4 5bebc26a3 c78584caa 7ee6685bd d8af0a56
e3a0db991 625de434d 582318bce 3ebe2bc3c ebd301053 5f579e6d7 e9810d2ae b893145b4 a7e7836d1 679dac13b 8d99e4704
1c7234de5 f23b8b6db de8a6f02f bd2026bf8 bb3903264 ede8048af 60161ef64 8fc791a5b 6a4546243 bc8187b47 ff2ca8dca
6bf71b837 78b8d1fe8 e738cdd2a 7aa80d490 fd1026293 c96fe6ad3 83f0f4f7b 75cb39786 b6ef13bdd f6a89f8a5 99a14349e
1ce6c16e5 a7597498f 145206424 13c9c5b3 d25775fc6 72311ca63 936d4cfe7 9ce43a505 663594c01 42d1be7b6 80b1dc92d
20e8e5b75 c2337a9e 58ae29f6b 90c553143 5b06da028 9415b2520 5dabcde8b d3c804332 28d103db 7be4cf210 56f76dd52
3877e1a3b 1f93eb430 588972ac c76cd7eb1 852596e61 6fa0ead03 d78be2bb6 56fdd6fd1 e265b0ebd cc715a846 ffb1e87a8
d9893a834 54c56923 63bbaac88 76a5585d4 607b37e59 ee4d4018b 7ef2d8dc5 c1c2d4285 1e0be0a7b 9fbdac67e dc5c74ca1
8366e2f1c abf1e4843 7b55f4dac 3d6150197 4e034c8db 63df500df 34b89afd5 a5ddabc7 9ee6ff8ec 3cdd9a682 a8d46f842
5fec25f7d 4216835cf 1624430f9 18afb5b6c 9ffd34c8e 95d5882ed 2e28d07cf fd9163bc2 a5d0833d8 3ebaf5bfd 89a7a3e54
85d3f7dd8 8af8d1ba1 a5b4e01b7 9f1accb0a 2fe5fcb31 2c4484bed a124de2ee 51471f700 14f7195f8 3ab7e9700 4542a74bf
9a01158f7 1f288d502 af0834285 c936df23f 2d38ea826 b1966249a bc43458d4 11eb6a09c d49d9986c dd9067c0e ce383aa71
739c5a2f 770f58eaa a5d87da4d 401b685ac c65512bc1 6999d7387 e23d36997 e30f1d174 16e46fc04 200efa090 18d86ea94
b75de5761 9e50de39d d7a0a0161 537a63844 e4f4de023 c5b83066f b9a2f9eb6 82a761d43 7088ad873 5b512f418 a373cf2e4
5937d7c89 cca051304 7a84e3efb 74d80c91b 4ad73e91d 490cea84a 52e4f1987 ec811379e b4f570589 5a6c46e81 ca857bada
bb9c86860 b2632ee04 3f597b324 7df14d546 5978d3925 98498767b 15966a839 6923743ef 52f38b460 6a2df69ed 84151f66c
1ee304eab a082ae4af de4e6afa 8131b4166 af5b7967a 16d942f84 dab10053e cce886f54 39bc89ef4 a5b7d9067 2fb039e23
6d82231d 3a946dd7 8b719555c 5352ece13 904fb9151 c7d7cc8d1 d20511b70 f2411eeb8 5b4a24ed9 c00fe866f eb118811a
cabf21b14 52e3a95f 506d306f1 22cd662d4 89161da55 7db947827 b70b47976 814e4e0ed 8cb8f07f3 b6979fdc4 b0eebb6b0
5ec980ef2 4b53ccab8 9c80770e3 b7ee43a52 a8ef24d04 9ec4f67e6 d5f2fb080 efc528d35 db181ccfb 39330efd0 1a7dd101a
4ac3982ec 7037e17dc 366188495 2458d8a7 5f004f923 4fe549703 4d33fc825 16f29207 a5b2b61a0 d9ea2cb3f 9d5e3b9b
4e473ff93 51e981524 68db475ad def9cdca4 44a257b51 50a9ee66a 7b40b799b 4111f2de4 cfcfb6b09 f2412713a 8d799e9dd
534748e45 32f291f51 30363bd3 12906d84d 6bd9344a9 61a5524f1 a94d8e02b 82d03a557 468cdf94a bdd69de40 ea8853fd9
d6caf9343 1755e839 badf446de fe70eae5a 1f3817ad1 91db0de1a c1fc0df55 b55de01cc 66c5829bd 33cb31ff9 ad671f856
534431aef d30fd939a 826d24c57 d40d5f1b1 58f22448c 83611d663 f4df3f635 1c1071941 f870bccb 13a62329e 6d6e094a0
13c44a6a7 129bc445b 59ee90dfd e0a5171a 5f92372ba 8638592ef d72f3b5 bc7e60a8c ce5895c63 e41b1ca5d e615ea62c
6993e2180 cc37d82c 26af573f3 1eb95a424 50e5fbc99 fb89b34b2 9571a8d0f 9d1a63a99 9a033e7e7 d77b20f8c ed2ce19b0
5731543c1 a59b97f53 1b3503950 7cc1f4899 3b5a20f14 3fb33bf95 24850c92f e3e322563 ba303ab82 5a004a3cb 1bc3a579d
bc3dd3ba0 df582df03 dfd57af2c 3863e1da0 dac52e26f 8eb863556 94d19e451 1d50d8f5f 27d1987de aadc2f1e d55af6b1d
737fe1509 a49e0fe3b 2a49eeaf9 c946b05c ca43c3583 19f868513 69cbd7558 5043e7034 616e82885 fd919ba26 b50ca391f
c1c578673 d4cb35af7 f82970fb0 2fe746c03 8a89c5009 6228cb500 27ea5af6b dbce2be47 bd304a07c 436d1ffec e616c764a
e50868951 8cb63318 6a39fbc8 d42cede82 814c745ce d9032244b e20bc0e5a 2ce95450b 15cae0ea8 4a2ff168f 3c6b4fe2f
1999a6d47 df7755c04 e2da75e1 cfb8748c2 6472c5913 ca51e4ce0 34f2ca384 7b305ce7c f3704894a 55945c075 104252729
b16e409ff 3676f5fc8 8b9ba144f a322964e9 9841268b 8c8912053 db2e4f8d1 62a58cbf4 34a15524c e73ea403 38492c5dc
865ab5b6d b638c0fbd 85ce2ca0e e45949e30 431f7881 4f8626706 f59c896ce 8d4e37dd7 72e5e016b 19c9570a6 eb0e55828
f3cb02a1b b609ff814 dab87f876 76d547356 b9f95ae4e 63a65e9e3 b6838a991 12b64eb81 c59ced5a6 d715aecdb b4291fe13
6d0d0693 f98794c86 5c816d4d8 c947590ff 80bb44a94 f59bd80c8 df761d2bc 217a8fb51 93d47240d 761920193 e4e5eba29
eeca76549 a1bbfc9c4 c711b2477 325b5a666 ce05f41f2 3da9c4cff 120c47b51 cd32263ae e799e7548 ae372d335 63ddbda3
267fac28c 1fc9d86b 17641543b c72e347da 6ffd0717a 3c30cb70f 820ea2bd 3e9d4bf2b a3c30b85c f9f0118df e4b9fe4d3
29c0611ae a8c35fa15 1b9e934ca 480cb9d1b bf800f039 c84dca5d6 7bc72f527 7b9239fae 7d89ef157 7ac85a437 d16f6d1be
edf98b6ff e8686dc27 4859dce4b 41627612 fc09cbd90 fdae828b9 8e8ab9aac e3c3a5acb df138b3f6 68b6499ce bf229a907
c5565d691 8f8119c05 96751f8e6 ac2f319d4 dc9a8a43b 23e877e11 6bd59226f 59360ec26 e9afc1dd5 de69624a6 de54a22a7
ea27ba143 8bcdef6a3 4779f40be 65a1a6cbc f31b71b67 1dee9ec9b a8bbd546b 4d77af897 53be52417 9ab39f2e2 c7672be23
85bb59414 f77b6f781 aecf29f03 3ea7deeb5 53154616b f0ad4172e ac97900c4 24af96431 742dcac09 b77612a7c 43f8e0b06
b9af4d04c 5f0c0eeb7 beed5d839 594bc055f bf3d4ee51 36dc329e7 6292a913d 853afc28d 8f669cd4d 35d67967d a1ba1cda9
475e70d85 db124355e b7464de4b 210a5d6ec 3f3b26a00 3b654ab0b 5461eabb8 add3bc40f 223eae50 d0a8f290d 70ec2982d
e98ba15a 1bf087c2e 6e98233f2 b06e2c22b 45483b62d 2fadab9ae 112d8a187 c1a9043c6 7abad130 92fd1710e f55801505
f42daa0b3 63e7b4d45 f976ab37b 59c9833d0 98cbdb021 da67a27ca d0e6edf39 d8fdd70b9 6b86d3b06 3979ed2b7 46a8a0a6c
fba0b5f5f c34a9713d 840e7387c ca04d9f6a 76073e651 e6f2fca96 daef51fa4 7824e6073 dbbb9e428 64bda5a5d d3944a8be
895b7c247 a8a092b5e 8454ae0f6 1a3109cc6 411731a19 ee3ccd9e5 865688814 84c59bdd7 bdf4f34e2 192b2633c f7c30ff94
bbd0187c5 36858be42 7cf38933f b1c48417e 77b63288c 794af1c0e b5afd4a02 92e67eb6b 6253569e5 1405ca65f 4ca61bba3
6fe876e9 c25b98680 bd52f241 de92bdbc6 7114244f7 c92109927 11246d25f 878963531 b8f639289 edd1ee2dc 2dd27bd83
5b77fb633 92d244fea ff29f378b cd74b01df caee75d99 32a7950e7 8ab7143d0 4a396d396 27cc982aa 748ffbcac 7dc1212db
60491f30f 6462a44c5 f693b3934 2c85c32c8 58842e73a 39c5c936a 59da18b06 b0c4be569 b38429749 14d177c42 b2890755c
c316f3c01 97a978118 6e3af9c97 b16bfcf5b fbdedeaa1 62d2efff3 221e13b03 6f189a8f4 ba3c855cf 4d9b593f1 70bdb83c4
7be402a75 acbb1dcf6 6d76dd708 4210a8723 e4a9e3182 b86ea177 589c7c8df 728f649cc 235daf936 ed5b13b07 9838cc62b
699ea0fb3 533af329d 486ec47d ea7e7874d ae99ea9c5 37e02d2d5 b92cf5ea1 e8c6fa527 93ac59f00 a5876d0fb 42664d4ab
672c67c2f a499d1a9b 1c55c99a8 5d5644f76 149b6cd96 5d19a752a fa5fce591 5380ec50c dea0d752d 1faf5309b e3b7a775e
173d59edb b8e38cca5 1e43cad4e 27dedf623 da72d480f 99434d76f 8e06320e5 12cc5d9b3 d4ec00d0a 8fa256ec8 2a7755b41
649598f17 48a9ea61 b749bbe4d 59e4c9da2 50395f36c 6b07149d2 4f9406d7f 92febe987 d7bf93ed2 1e66cc0f3 6c48e37c0
3ad8159d5 48f41fbc8 cd5f40d31 4d9d50e50 377552d44 d6400b5bf 205260a56 c319eaf12 bb3016818 194c9caa5 3205df053
8dbf64dc8 5cc34b609 7d2367f18 20d6cee2e c9f86c18e e2b1f4620 9c52f03e 7d8b9b31 2b85f049f e0b542614 d0f06b745
df7b0f962 d7b41890f 24baf7927 cc63c5347 c9dbe3e8e 52b1c7225 73f558c8d 542702b85 578f18fdd a76cf36ef a3cb92407
b7ad6cd05 6d0f34533 416083d1b 2bdb7fab0 29619e1d2 fe824f4c1 7a5ff22b9 5be7f7ce2 4140ddebe ec104f338 3c6ea6417
4c68c4841 738550624 95d52ffbe 1211a3407 85c2667c7 d3fcfc70a 62c79fa03 e5a01d1de 21a6f78c0 67a9d08d0 3521d86a9
821858962 238c9ab4 d377e444e 9b4db4370 326d40d28 cca399d64 29e717061 81c257536 b5398ff6f 6246d505d 52de44206
d4bfe70a7 1256f3bbf e18dca845 cadc6270e ceecebcf9 30490b131 3499eae73 e407687b5 d16a1b5c aed4fc7c 977235ace
e45bc089c d1c7e8b0f c801f2a62 9bb982feb c2ade21d5 e664c4cdc b5b1b7d8d 57e319e42 a62708260 4d49e8e90 cb5f349a
97f8c8487 bf26ecbd1 6a22fc93f f40123ad5 f2864b84f 52b894393 aeac3e443 64a6e37e9 5ff905511 f9368ae9 304c961d1
901e3d5ef 3d9c9e1ea 14af08310 f7d5f48fa 4cc90c712 93eb3c4f2 c64af2ee0 ee9b0b880 59e9f00c4 f0e385a56 13e3176a
22cefe2bf e8d646da2 fa07e9914 64a342dc3 29436fde 3f436a788 ebce59d33 d1cc417e5 bdabb3afc 2b075aa91 cf479bc86
1bc69c922 f70bed102 73fba7412 dad289c99 25fa19a7e a5a248105 59c85904f 587368f7a 6ddf6cd9b 276aaeac2 39793390e
ee79121bd 43b22f813 137d42357 67857c8bd 46cf4e741 1d18cd171 a9806c31f 6605176c f592c1ac 7265a10a4 e89d3f153
b2c1d25d5 fc221a68c 21bc5cb0f 7d8865a48 14fb6a9c1 826702ff5 c875eecdd 334906e55 e75f38920 e68cc8585 e21989dad
991c0a54f afc2e4db2 49215ae09 4414dd21c 270102c2b d74d46724 d8ba0e6cf 4924c591c 14a218727 ec649a317 40506e864
4a5fce324 432da3920 be6c87867 96d47ab50 13b26554a 42d294c1a 43a8f4537 ec9981703 9d23e9fea a5e63c741 b590555a7
af5cc76d0 36f6807be d9e7509ba 8e7485e6 ca410c173 34c0efac9 aa8dd95f8 92ff8e340 2fcf617e5 f4ee3deea ec3675f06
11d3034cc 53d80da67 2ffd3e2ed 701c5dbca fd41bd301 176d0d999 84a7a607a 3a4cd4f6e 29fd854f3 239143be4 c1d83b7ce
3998e35f9 c9cade2fe 67a7ce5f8 58096eb5e 129003b1a 58cd60dd3 7ec9c978c 8209b7fc6 b1a07b065 2f8c5d980 ec68f5262
9f6738ae8 e240da32d 29a692dd3 93a2fc212 90a7ad415 38462d719 88d09ed64 629414143 f37f54627 f654223da 9866d0462
39b7e344b e29b0d31e 4d26f996b ca999e2d4 48244ceca db430a091 b20a09f71 89d7a977d d0c7d781f 45dbd608b 5f0eaf573
4b72a881e 6721d71ac aea5b5257 729da786e b7bbb055e 33c26e035 bbb1faaf3 a7acc30bc 1ce0841a4 244d1d408 cde684816
f8fb4cda 706c97e43 c971d3afb fda0d9c09 16b86da3 fad3fd2e5 bac1633c9 2309feea7 33737bb 9aed89097 68538abb5
828f7850d 72432d95d 261a8e5a9 a200eb1b2 c3de7f043 bf74c5970 6dd1481b8 aa94bbef6 da7e65697 bc3ab5693 fac70dbec
11c7b546d f2f1877ae ddfd559cb 213843237 d35629a71 66b966ff8 f7c3d2b42 d2a9bf013 82aade491 80a74d66a c23180cd5
13bc699af 568f373af 4e8f6cb22 236593da c06d419da fb63c9338 c58ea0e62 3f129af28 1bc5d8e7c 5a0cce5a2 12138fcc9
6475b47b3 36127061c a66ea1c90 c7622d06f 7b06f9883 17f9dd0f5 4f7d20a59 80ca1778d 34bf99f09 b1f6b20ff ddc248171
79adedf2d e7b8ec414 1660b1a2a 596131143 ed5876f22 ccf196212 5a7da3ed3 5d7c1c564 ebf3b80d4 fbb5da08 751b26b7f
f646e15e0 48cf268f5 681ff913e 8a60709ee ee8aa3c19 d74c7190b 403a516f6 43859f5e7 674b05601 29dc78f7b f871a0d9c
149cd7e80 e0ebb3dad cfd60dc21 fcac192f3 da0bb9f49 377891815 8cf831888 d8ad9cff2 66ef37c63 289532c5d 45d8a5400
452111b4d be9b62af0 4a7fa60af f38ab400e 329b05789 5edba3023 5f48632e5 c44562244 781f865e7 4868de42d b7d2aafdd
652863c6 9c8c0a919 a566fd21e d42a60c7a 3b2fa8afe 4feead808 4e08205a5 2ca3d8a2f 983fc5a57 c23db45c9 a37e0ba04
5f510ba05 1601a2ff1 30cccbfe0 3880f5176 ea5aee4f b1b166fdb 7b3ca3761 64fae3ebf 447b9e7ac d9f564f30
"""
TAG36H11 = """
d7e00984b dda664ca7 dc4a1c821 e17b470e9 ef91d01b1 f429cdd73 5da29225 1106cba43 223bed79d 21f51213c 33eb19ca6
3f76eb0f8 469a97414 45dcfe0b0 4a6465f72 51801db96 5eb946b4e 68a7cc2ec 6f0ba2652 78765559d 87b83d129 86cc4a5c5
8b64df90f 9c577b611 a3810f2f5 af4d75b83 b59a03fef bb1096f85 d1b92fc76 d0dd509d2 e2cfda160 2ff497c63 47240671b
5047a2e55 635ca87c7 691254166 68f43d94a 6ef24bdb6 8cdd8f886 9de96b718 aff6e5a8a bae46f029 d225b6d59 df8ba8c01
e3744a22f fbb59375d 18a916828 22f29c1ba 286887d58 41392322e 75d18ecd1 87c302743 8c6317ba9 9e40f36d7 c0e5a806a
cc78cb87c 12d2f2d01 379f36a21 6973f59ac 7789ea9f4 8f1c73e84 8dd287a20 94a4eee4c a455379b5 a9e92987d bd25cb40b
be98d3582 d3d5972b2 14c53d7c7 4f1796936 4e71fed1a 66d46fae0 a55abb933 ebee1acca 1ad4ba6a4 305b17571 553611351
59ca62775 7819cb6a1 edb7bc9eb 5b2694212 72e12d185 ed6152e2c 5bcdadbf3 78e0aa0c6 c60a0b909 ef9a34b0d 398a6621a
a8a27c944 4b564304e 52902b4e2 857280b56 a91b2c84b e91df939b 1fa405f28 23793ab86 68c17729f 9fbf3b840 36922413c
4eb5f946e 533fe2404 63de7d35e 925eddc72 99b8b3896 aace4c708 c22994af0 8f1eae41b d95fb486c 13fb77857 4fe0983a3
d559bf8a9 e1855d78d fec8daaad 71ecb6d95 dc9e50e4c ca3a4c259 740d12bbf aeedd18e0 b509b9c8e 5232fea1c 19282d18b
76c22d67b 936beb34b 8a5ea8dd 679eadc28 a08e119c5 20a6e3e24 7eab9c239 96632c32e 470d06e44 8a70212fb a7e4251b
9ec762cc0 d8a3a1f48 db680f346 4a1e93a9d 638ddc04f 4c2fcc993 1ef28c95 bf0d9792d 6d27557c3 623f977f4 35b43be57
bb0c428d5 a6f01474d 5a70c9749 20ddabc3b 2eabd78cf 90aa18f88 a9ea89350 3cdb39b22 839a08f34 169bb814e 1a575ab08
a04d3d5a2 bf7902f2b 95a5e65c 92e8fce94 67ef48d12 6400dbcac b12d8fb9f 347f45d3 b35826f56 c546ac6e4 81cc35b66
41d14bd57 c052b168 7d6ce5018 ab4ed5ede 5af817119 d1454b182 2badb090b 3fcb4c0c 2f1c28fd8 93608c6f7 4c93ba2b5
7d950a5d e54b3d3fc 15560cf9d 189e4958a 62140e9d2 723bc1cdb 2063f26fa fa08ab19f 7955641db 646b01daa 71cd427cc
9a42f7d4 717edc643 15eb94367 8392e6bb2 832408542 2b9b874be b21f4730d b5d8f24c9 7dbaf6931 1b4e33629 13452e710
e974af612 1df61d29a 99f2532ad e50ec71b4 5df0a36e8 4934e4cea e34a0b4bd b7b26b588 f255118d d0c8fa31e 6a50c94f
f28aa9f06 131d194d8 622e3da79 ac7478303 c8f2521d7 6c9c881f5 49e38b60a 513d8df65 d7c2b0785 9f6f9d75a 9f6966020
1e1a54e33 c04d63419 946e04cd7 1bdac5902 56469b830 ffad59569 86970e7d8 8a4b41e12 ad4688e3b 85f8f5df4 d833a0893
2a36fdd7c d6a857cf2 8829bc35c 5e50d79bc fbb8035e4 c1a95bebf 36b0baf8 e0da964ea b6483689b 7c8e2f4c1 5b856a23b
2fc183995 e914b6d70 b31041969 1bb478493 63e2b456 f2a082b9c 8e5e646ea 8172f8f6 dacd923e e5dcf0e2e bf9446bae
4822d50d1 26e710bf5 b90ba2a24 f3b25aa73 809ad589b 94cc1e254 5334a3adb 592886b2f bf64704aa 566dbf24c 72203e692
64e61e809 d7259aad6 7b924aedc 2df2184e8 353d1eca7 fce30d7ce f7b0f436e 57e8d8f68 8c79e60db 9c8362b2b 63a5804f2
9298353dc 6f98a71c8 a5731f693 21ca5c870 1c2107fd3 6181f6c39 19e574304 329937606 43d5c70d 9b18ff162 8e2ccfebf
72b7b9b54 9b71f4f3c 935d7393e 65938881a 6a5bd6f2d a19783306 e6472f4d7 81163df5a a838e1cbd 982748477 50c54feb
d82fbb58 2c4c72799 97d259ad6 22d9a43ed fdb162a9f cb4a727d 4fae2e371 535b5be8b 48795908a ce7c18962 4ea154d80
50c064889 8d97fc75d c8bd9ec61 83ee8e8bb c8431419a 1aa78079d 8111aa4a5 dfa3a69fe 51630d83f 2d930fb3f 2133116e5
ae5395522 bc07a4e8a 57bf08ba0 6cb18036a f0e2e4b75 3eb692b6f d8178a3fa 238cce6a6 e97d5cdd7 fe10d8d5e b39584a1d
ca03536fd aa61f3998 72ff23ec2 15aa7d770 57a3a1282 d1f3902dc 6554c9388 fd01283c7 e8baa42c5 72cee6adf f6614b3fa
95c3778a2 7da4cea7a d18a5912c d116426e5 27c17bc1c b95b53bc1 c8f937a05 ed220c9bd c97d72ab 8fb1217ae 25ca8a5a1
b261b871b 1bef0a056 806a51179 eed249145 3f82aeceb cc56e9acf 2e78d01eb 102cee17f 37caad3d5 16ac5b1ee 2af164ece
d4cd81dc9 12263a7e7 57ac7d117 9391d9740 7aedaa77f 9675a3c72 277f25191 ebb6e64b9 7ad3ef747 12759b181 948257d4d
b63a850f6 3a52a8f75 4a019532c a021a7529 cc661876d 4085afd05 e7048e089 3f979cdc6 d9da9071b ed2fc5b68 79d64c3a1
fd44e2361 8eea46a74 42233b9c2 ae4d1765d 7303a094c 2d7033abe 3dcc2b0b4 f0967d09 6f0cd7de 9807aca0 3a295cad3
2b106b202 3f38a828e 78af46596 bda2dc713 9a8c8c9d9 6a0f2ddce a76af6fe2 86f66fa4 d52d63f8d 89f7a6e73 cc6b23362
b4ebf3c39 564f300fa e8de3a706 79a033b61 765e160c5 a266a4f85 a68c38c24 dca0711fb 85fba85ba 37a207b46 158fcc4d0
569d79b3 7b1a25555 a8ae22468 7c592bdfd c59a5f66 b1115daa3 f17c87177 6769d766b 2b637356d 13d8685ac f24cb6ec0
bd0b56d1 42ff0e26d b41609267 96f9518af c56f96636 4a8e10349 863512171 ea455d86c bd0e25279 e65e3f761 36c84a922
85fd1b38f 657c91539 15033fe04 9051c921 ab27d80d8 f92f7d0a1 8eb6bb737 10b5b0f63 6c9c7ad63 f66fe70ae ca579bd92
956198e4d 29e4405e5 e44eb885c 41612456c ea45e0abf d326529bd 7b2c33cef 80bc9b558 7169b9740 c37f99209 31ff6dab9
c795190ed a7636e95f 9df075841 55a083932 a7cbdf630 409ea4ef0 92a1991b6 4b078dee9 ae18ce9e4 5a6e1ef35 1a403bd59
31ea70a83 2bc3c4f3a 5c921b3cb 42da05c5 1f667d16b 416a368cf fbc0a7a3b 9419f0c7c 81be2fa03 34e2c172f 28648d8ae
c7acbb885 45f31eb6a d1cfc0a7b 42c4d260d cf6584097 94b132b14 3c5c5df75 8ae596fef aea8054eb ae9cc573 496fb731b
ebf105662 af9c83a37 c0d64cd6b 7b608159a e74431642 d6fb9d900 291e99de0 10500ba9a 5cd05d037 a87254fb2 9d7824a37
8b2c7b47c 30c788145 2f4e5a8be badb884da 26e0d5c9 6fdbaa32e 34758eb31 565cd1b4f 2bfd90fb0 93052a6b d3c13c4b9
2daea43bf a279762bc f1bd9f22c 4b7fec94f 545761d5a 7327df411 1b52a442e 49b0ce108 24c764bc8 374563045 a3e8f91c6
e6bd2241 e0e52ee3c 7e8e3caa 96c2b7372 33acbdfda b15d91e54 464759ac1 6886a1998 57f5d3958 5a1f5c1f5 b58158ad
e712053fb 5352ddb25 414b98ea0 74f89f546 38a56b3c3 38db0dc17 aa016a755 dc72366f5 cee93d75 b2fe7a56b a847ed390
8713ef88c a217cc861 8bca25d7b 455526818 ea3a7a180 a9536e5e0 9b64a1975 5bfc756bc 46aa169b 53a17f76f 4d6815274
cca9cf3f6 4013fcb8b 3d26cdfa5 5786231f7 7d4ab09ab 960b5ffbc 8914df0d4 2fc6f2213 ac235637e 151b28ed3 46f79b6db
1382e0c9f 53abf983a 383c47ade 3fcf88978 eb9079df7 9af0714d da19d1bb7 9a02749f8 1c62dab9b 1a137e44b 2867718c7
35815525b 7cd35c550 2164f73a0 e8b772fe0
"""
STANDARD41H12 = """
1bd8a64ad10 1bdc4f3b2d5 1bdff82b89a 1be3a11be5f 1be74a0c424 1beaf2fc9e9 1bee9becfae 1bf244dd573 1bf5edcdb38
1bf996be0fd 1bfd3fae6c2 1c00e89ec87 1c04918f24c 1c0be36fdd6 1c0f8c6039b 1c133550960 1c16de40f25 1c21d912074
1c258202639 1c292af2bfe 1c307cd3788 1c37ceb4312 1c3b77a48d7 1c3f2094e9c 1c42c985461 1c4a1b65feb 1c4dc4565b0
1c516d46b75 1c55163713a 1c63b9f884e 1c6762e8e13 1c6eb4c999d 1c725db9f62 1c7606aa527 1c7d588b0b1 1c81017b676
1c84aa6bc3b 1c88535c200 1c8bfc4c7c5 1c96f71d914 1c9e48fe49e 1ca1f1eea63 1ca59adf028 1cb095b0177 1cb43ea073c
1cbb90812c6 1cc68b52415 1cca34429da 1ccddd32f9f 1cd18623564 1cd8d8040ee 1cdc80f46b3 1ce029e4c78 1ce77bc5802
1ceb24b5dc7 1ceecda638c 1cf27696951 1cf9c8774db 1d086c38bef 1d136709d3e 1d1ab8ea8c8 1d25b3bba17 1d295cabfdc
1d30ae8cb66 1d3f524e27a 1d42fb3e83f 1d46a42ee04 1d4a4d1f3c9 1d519efff53 1d5547f0518 1d5c99d10a2 1d6042c1667
1d6794a21f1 1d6ee682d7b 1d763863905 1d7d8a4448f 1d813334a54 1d84dc25019 1d8885155de 1d8c2e05ba3 1d8fd6f6168
1d9e7ab787c 1da5cc98406 1da975889cb 1db0c769555 1db47059b1a 1dbbc23a6a4 1dbf6b2ac69 1dca65fbdb8 1dce0eec37d
1ddcb2ada91 1df651402f4 1df9fa308b9 1e014c11443 1e223c84830 1e25e574df5 1e383226ace 1e3bdb17093 1e4a7ed87a7
1e4e27c8d6c 1e51d0b9331 1e592299ebb 1e60747aa45 1e67c65b5cf 1e6b6f4bb94 1e766a1cce3 1e9008af546 1e9eac70c5a
1ea2556121f 1ead503236e 1eb84b034bd 1edce466e6f 1eeb8828583 1eef3118b48 1ef2da0910d 1f0526bade6 1f10218bf35
1f1b1c5d084 1f226e3dc0e 1f34baef8e7 1f3c0cd0471 1f435eb0ffb 1f55ab62cd4 1f5cfd4385e 1f67f8149ad 1f7dedb6c4b
1f88e887d9a 1f8c917835f 1f903a68924 1f9b3539a73 1fa9d8fb187 1fd21b4f0fe 1fd5c43f6c3 1fe0bf10812 558741c4
caa54d4e 13fc358d8 2d9ac813b 34eca8cc5 38959928a 43906a3d9 4ae24af63 4e8b3b528 52342baed 857150bb3 9b66f2e51
adb3a4b2a b8ae75c79 e499ba1b5 f6e66be8e 10cdc0e12c 1142deecb6 1351e620a3 143c2237b7 17356582b8 17aa838e42
181fa199cc 18cf4eab1b 19446cb6a5 1aa3c6d943 1b8e02f057 1bc891f61c 1e4cb73593 22303697a8 231a72aebc 23ca1fc00b
2688d40547 26c3630b0c 2738811696 27e82e27e5 290cf944be 2b568f7e70 2b911e8435 2c063c8fbf 2cb5e9a10e 2d2b07ac98
2e1543c3ac 2e4fd2c971 2f3a0ee085 31f8c325c1 326de1314b 35a1b38211 3651609360 368bef9925 373b9caa74 37b0bab5fe
3b1f1c0c89 3b59ab124e 3bcec91dd8 3c0958239d 3d68b2463b 3e185f578a 3e52ee5d4f 42366dbf64 4320a9d678 435b38dc3d
4395c7e202 444574f351 452fb10a65 45a4cf15ef 4aad1994dd 4e5609f12d 506511251a 52e9366491 535e54701b 53d3727ba5
54831f8cf4 565797bb1c 5bd5004594 5c0f8f4b59 5de4077981 5f08d2965a 602d9db333 64c0ca2697 6535e83221 65e5954370
665ab34efa 66cfd15a84 67ba0d7198 682f2b7d22 6953f699fb 69c914a585 6a03a3ab4a 6b286ec823 6c87c8eac1 6d720501d5
6f810c35c2 6fbb9b3b87 71caa26f74 73648b97d7 741438a926 757392cbc4 7dea3ea13d 7ed47ab851 827d6b14a1 82f289202b
832d1825f0 8367a72bb5 83dcc5373f 886ff1aaa3 8a09dad306 8a4469d8cb 8cc88f1842 8d3dad23cc 8ded5a351b 8f87435d7e
90717f7492 915bbb8ba6 92f5a4b409 974e4221a8 9997d85b5a 9a47856ca9 9e2b04cebe a0e9b913fa a36dde5371 a8b0b7d824
a8eb46dde9 aa1011fac2 ac59a83474 afc8098aff b24c2eca76 b2fbdbdbc5 b3e617f2d9 b545721577 ba132d8ea0 c005b424a2
c3e93386b7 c5488da955 c5f83abaa4 c9669c112f cdbf397ece ce34578a58 cea97595e2 d426de205a dbeddce484 ddc25512ac
e75dcc04fe ebb669729d ef99e8d4b2 f0f942f750 f342d93102 f6ebc98d52 fa1f9bde18 fb09d7f52c fbf4140c40 feed575741
10345f4c4e0 1051a6cf308 1084e3f43ce 109387b5ae2 109e8286c31 10a5d4677bb 10b0cf3890a 10c31bea5e3 10d5689c2bc
10e0636d40b 1129963476f 113839f5e83 11a25d305d4 11b4a9e22ad 11bbfbc2e37 11dcec36224 11ef38e7efd 11f68ac8a87
11fddca9611 12018599bd6 12052e8a19b 12a9e0ca53c 13056043579 13523bfaea2 140ce3dd4e1 142dd4508ce 14a2f25c16e
14aded2d2bd 14e12a52383 152a5d196e7 153557ea836 154052bb985 154b4d8cad4 154ef67d099 157ae1c15d5 157e8ab1b9a
15b1c7d6c60 162e37c308a 169c03edda0 16ec8895c8e 16f3da76818 171121f9640 182af245281 18aeb412235 18b9aee3384
1920292d510 195e6123725 19ab3cdb04e 19bd898cd27 19d37f2efc5 1a2b55b7a3d 1a6d369e217 1adeabb94f2 1b3dd422af4
1ba7f75d245 1bb2f22e394 1c15c387f5b 1c6d9a109d3 1cc91989a10 1d83c16c04f 1e127e0a152 1e42123ec53 1e6dfd8318f
1e879c159f2 1f75811d0f7 1f87cdcedd0 1f8f1faf95a 168a6ced3 a19e1aa11 b3eacc6ea e37f011eb 1081864b9d 188314158c
1f5fd6c2a2 216eddf68f 38fe6948d2 3fa09cf023 41ea3329d5 4caa753900 4dcf4055d9 52d78ad4c7 56807b3117 58ca116ac9
5ebc9800cb 6265885d1b 70942bc2d1 738d6f0dd2 7adf4fc672 85da20db62 8a6d4d4ec6 8ae26b5a50 8b92186b9f 8ec5eabc65
96525a7aca a0d80d8430 a5a5c8fd59 a9142a53e4 b48419745e b86798d673 c6963c3c29 ca3f2c9879 f0e7976786 f41b69b84c
fe668dbbed ff163acd3c 1015fd106ee 10fc9037269 11e6cc4e3a9 136716e4176 13f97c7283e 142567b6d7a 148f8af14cb
14a92983d2e 14ca19f711b 14d16bd7ca5 157d6ff8bd0 15eee513eab 16ca7d698d7 174a96462c6 17593a079da 177a2a7adc7
1808e718eca 181038f9a54 190918d22a8 19e1083770f 1ac3f26dcc5 1b47b43ac79 1b8d3e11a18 1bbcd246519 1efb9f682c8
5af98aca8 26a00beb78 5808b8c9b0 654d201852 7c2cfe5946 8d1a560438 a4e4705c40 a81842ad06 bce919ba0d c5253689c1
d4edc317da eaa8d63bf5 10fb757e29f 119c7ece07b 137bf1cd44a 141cfb1d226 15c58806f6a 165444a506d 16babeef1f9
16d0b491497 1875988ac16 190f4ff9e68 198f68d6857 1a60065b134 1ad17b7640f 1af26be97fc 1b22001e2fd 1b469981caf
1b84d177ec4 1b9ac71a162 1ba5c1eb2b1 1ce42b9a8a4 1d13bfcf3a5 1dad773e5f7 1dcabec141f 1e01a4d6aaa 1e1048981be
1e388aec135 1e97b355737 1fe4c0c643e 15db97b681 42eba7271a 444b0149b8 4bd771081d 7fc44325cc 992846a637
9b71dcdfe9 b71f769a06 c254d6b4bb e5c96f3302 f8c5ce11e1 fe08a79694 1090378ab84 1093e07b149 10bc22cf0c0
10ef5ff4186 11b502a7914 126858a93c9 12b53460cf2 142a8425970 15f7aa73066 1a0e66fa27c 1d5bd7dd73f 1ddf99aa6f3
10c1a1a7c9 1b81e3b6f4 21e9885880 259278b4d0 3ad86dcd61 3ef67c353b 99169b166d a2eca10e84 b4fec3d64f b70dcb0a3c
b832962715 cbdea21743 ced7e56244 de65e2ea98 f002e7a6d9 12589a2eceb 149e8778246 1672ffa64c6 1be56d5faf7
1ec8bb08869 1f5777a696c 17c747cada 454c7546fd 7d91e4d24b bb1a2de24c 1070ba95dc8 1274c6f8b49 12920e7b971
14a4be9fe06 15003e18e43 17f22f832c9 1f3cbe5b13f 1fd2ccd9dcc 1cbde6b9fe 1ff1b90ac4 2cfb9153a1 302f63a467
4e61229dfb a00a95a9b4 b21cb8717f dd584fb3f0 12615f8dea6 12f76e0cb33 13fb48b64d6 16e5e83fdd2 170a81a3784
19506eeccdf 1aa4ce3e570 58257d0648 640a8a324c 7e9358cf90 8b28130ce3 c4ccdcbacf c71672f481 d45ada4323
1181038eeeb 14dd1833ac2 163c72564a2 17ec5120d70 2dfd0550e6 484b44e865 79b3f1c69d c6551a5368 ee976e4ad8
11f506e17c1 15636838071 17eedf5836b 1a55bd14cb3 1f8d9bc8694 33a3515159 580225e6b4 637215072e c0c6063926
1565f66f66c 15db147af0c 18cd05e5392 1b2c91c1150 8cc7888bad 136821344ab 1631d04a9ba 1b91f152312 1cd403f1eca
1d1d36b922e 1f129f5a89b 2bb8fb6d9b 6bc569bd13 113ab7c47e9 1166a308d25 131a2ac3bb8 170c4de741c 1cf7829c8b2
1e39953c46a db01fea02 82ce2b7402 aa60d25a23 b645df8627 b6806e8bec cdd56ad86a 12954e3dc3a 13fbfa411a4
182c555ac1d 19e72ef663a 1a4a0050201 1af25b80b67 1b552cda72e 1bb0ac5376b 1d43439b211 e88b0714c 27ecb3f1b7
5cc3c2267a bbec2b869a fa993fb374 111ee3bfff2 16c0e5ae124 18e23993ccd 17d7ecce0f 72a7b8c090 7cf2dcc431
a9533f237b e039548c2b 101d974dc4a 143f4ea5faf 147634bb63a 15f2d660e42 16386037be1 180cd865e61 1b2e5e04de8
1b4ba587c10 2127292ad2 71abd119b2 7220ef253c 8d93f9d994 c59eda5f1d d7b0fd26e8 17dfd26895b 1c177f62f5e
1c854b8dc74 1f6899369e6 1035006e519 12b925adc89 15b9bad9823 1a927123c02 155953e4ff 6ae64652cd d4cef1c218
e3ad42391d 15c39af19a8 192aaa676ce 1bb621879c8 a52911823e ac05d42f54 dda9101351 1842fc87b89 1f4691c347
bce1804a7c 10c06ce16be 14b638f54e7 1f6b8033648 f31ca9f9f 2c042f7695 f4659734b1 ff25d943dc 1ade8ae7bc8
1c836ee1347 2a1e0bb8a3 3eb453bfe5 fdb4d39174 1843554d1f0 1c68b595b1a 51d99614bf 18dbf203478 1f76d3c9dfe
7f1288fb53 aa139137ff b5be0f5e3e 15c7f56cc3b 1a11ef18f17 1cfc8ea2813 eba83d2010 181f14aeea5 aacd6af7
4bec9bd524 54d865b627 1758574274d 6e654cac8d 1156123204f 122a58a6ef1 1d07e238fc9 1f3b82d084b 7f0669c1f0
9a3ee57083 11cdbe74eea 1717e9da5a4 174b26ff66a 158130ce65 acef09b9d3 178f961d43f 1a6097144d8 1d145088749
1b620bd49d 16d77c723fb f046824042 13d5cc8d897 6d5d45cc4c 1407eef9993 16552e23a78 1d18523e375 d38f4c54e
1996897ce22 19bdb117dcf 1d19c5bc9a6 1d6df354e59 7898323d68 10545c919ab 15938d25f16 194b2143b2a 387a185e26
d4408eb733 11ed2b01011 1436c13ab31 16840064c16 1d81b385163 97cb653441 1c791532231 1e8f6e46c8b 7654285a1d
fe6e92c2fc 19dddf97859 8d225b0b47 10623e5f75c 1bdd285104b 4ffd847706 1bc617f5de3 4e1760b914 157aa01e381
a9fa4c38a4 10617c6bdf9 10826cdf1e6 1386aafb345 f3329fc54b 1caace70031 32ce59144 f11f2bd48 9557e4f7ff
106cd0025af 7f8b26441a a499a7eac4 151b0e86a83 354acbd732 a7aa231bf6 3748277b55 5ccbc72d89 139c376f2e7
8b566c88a ba36f045b2 17be478ccb3 1f7930c6e3a 5b4ea241be 2abe85ead0 10aaf78fb2f 79227b15f9 15e1bb8a546
194c73f0831 1e1686794fc 1e252a3ac10 a86a75307a 1701c2fdd47 1728ea98cf4 1aca891466a 107e4a57c90 1409f331368
19666b486fb 42304673e6 1873c297a67 7645fc0790 148084bb239 160bca22155 2d01894186 9c2d0e3584 152b6e2319a
1f818cf7cf9 891091c61 2095b27a2e 4912957763 a027c57dca 1d68fe7130b 47f356b0f1 176f7ebfdc8 1a8d5b6e78a
fe0d98f7e4 6c0b7d0724 1b6f83b13dd 19b38f5c9f6 1d886afd432 1f93c940d3d 1fe4fedc4a 6ecfbda2c7 19f4558a206
4d566a3b2 1071627157f 1e81a39b2ed 10f0b95a60b 13db58e3f07 1c3fb8079be 1294829adc0 fe3575e14a 18a6deeb203
95fdeb8093 19d75663db0 53d5ee944 18f236bb866 1fb1b1e5b9e 8f7e086c41 a782b1ca0e 9d9b00422d bfeacda39b
31cc3114f0 f9b87ac782 1c80c691ba0 67eee42b5 d2a07e4352 134c22aee73 13bd97ca14e 6fbd78f718 e6004f9df1
18c755c765f 10f441792a6 16359716b10 1f2dcf472c0 2c0ca01522 199f8d89498 16843f120d1 75ba11ad53 1df24c9492f
19ee5e13f4 566913ed4d 64c09ac8fe 1be511a46f7 be48447f12 1061bb192b4 b0b7a29ae1 1473b3f6f3b 16044bcee3
1c065add14b 1d068c96529 8ad61cc354 45b544bb8b 11c9716cb53 4a136e7f91 104a9a553b7 49f0175ffd 114cc1af56
103b34a0340 15ed4dce1b7 14f86fab58f 1e6f4d3a0fd 109681bb0b 14a95e81cd2 1320a7523b1 306d4289d0 d429277369
15ba89e9fc 1900679f767 185113538de 1b6b4711cdb 1f6fb6e7218 1221c845cda 1dde29efaa7 3633d20418 1dcf1d00097
eefb1d007d 77bc5eb2c6 c1529864c6 26f10884be b18f982d14 5d7937c815 2b89c14e89 d80e5caf0 163101b1da7 18c3cab2c2b
eee1d80122 1ea45d5c5d9 cfdd14d6ab 90a9370e7d c8dcfb0a01 1024735b228 1c2cff31c50 1156058cd9f dc5990a138
1e21fea4fc1 8b5937c3d2 145b4df9233 14fcb00e676 9d4170890d 6a2d2ef2a8 3e59228519 4a1ad89189 62abd7e111
19c3bac8db5 18abb6c0e0c 1d959f03efa a3cfeb876a 1e8b8776e57 1787f5f43b1 1ec5ad4e7ab c2b05105b8 96a1b59264
12999264706 81ca4ba261 9134f20b21 179d71ff6be 1243881f926 c8f9245182 cba62d06f4 176b7b9af7 1108b6f7c63
1880a492646 1e3fee035a0 1668160bc58 2733019c7b b9de37bb8e 12ed8ec25fa 4f62a3778c 17360487610 14e33fc0639
a0a10a97f4 1763aba6b4f 1dc7a757e4a 17abc3b4ee9 1eaaea53a67 145007d5979 1dce3745071 1f1b44b5d78 3b73688573
5cd8f9cfcd 1785a66a271 8f0e17fbec f9488a572d e860bf02a2 1fdd86d5913 6a3eab24d9 1f45f46f9c0 1f1414a0dd
922e31a3be 106c46d05d5 79a744746f 5ffcaf33e b44162e63d eaf2759f8f 6a28e562bb 1746a2d11e2 edae163f0c 31890eef51
837829ad9d 82698fea60 dac5dba09f 1b83dc21e55 fdad17a096 1042bf42853 379ad27293 8ade2ea6af 2492545a51
128bcb7c74d 16f9336a77c 11c2c8353cc 110643a6460 1dd0b8d73bc 8650fa2130 18ba7c21a96 28c1735cde 126fb5d4d02
18a939c00f2 3717f3abfa 4f797ca28b 54875377e0 1dda46e3658 1f4fef6d93d ef43b5d782 154eafbbf5f 185512e13bd
85bd765762 1638db6a40a 7070ee5bd5 18ba62098ea 1a300a93bcf 18db9ad96a9 95c21fecd 3df20e4acf 7b05394f46
72b0de0ccc f8c759ee8c a12fe616a3 1ad5de466b8 1bd329666b cc98e698e1 1593a5e3bc1 1b09bc8d7b7 d7d95f6064
146d56dfb6b 151ace7f0c7 5235f47104 160552f2bd9 b85d711139 1b9909e4c5e 1e9fd6383b8 13aa2a4a94 1cd28f19398
1328cd2adcb 36f95e901d 1ff1761808f 1bf5cba1d0d 152fb021b19 f9ecfc3a61 ac948d2cb6 b7e1788fe 121f739dcb4
1c85a9b2558 5e91fd6423 1986779c35a 146247fa70 19160cd13b4 e990ebe27a 121ff3ee3c3 103173ff5e4 999d1faf27
1bed034cdb9 129c2237599 b73e6e84ac 14fedd6c98b 32fddcf527 112f9e8b254 1c2b79f0489 c92da5c461 1eb749d5dea
146d88e7d76 12775e52da6 19c87d17e43 7c8ffc74d3 15f7e792e6 28d0ef5231 748148e4ec 9fd9a463f5 159974ab0d1
7b2e95390b 1ff14f5ac33 1f655a5054 acf593d41a 898c1402a1 93b3e0e6ae 18d45df2de5 11ee6cb87ce 10936d11081
1cae4599782 188e5a850b5 cd074f4022 1dfca5b7190 b68e62b82b 16e8dc2307b 17c57ec8ddc 2826044499 106bc22fc2c
c14f105ed4 15af4d3f42a 137e93a480a 1849474f50e 16dba230a81 1739183125 135fefc57c4 b3f2d634ea 29710ac92c
148cf641ae9 6708f24fcd f94815f6fa 121607febda 805bb5d7ec 1c39320b045 62000cdbc8 14ac177b4a5 63a51304e
12443627fa6 1acd66a314c f3b5bed960 1517dc78a4d 16839481f18 7aa6079abe 1f6e9c6f5e5 942c5bae28 458cd0f0a5
1432717dd98 e39ebb3ef5 1f0115ab508 1662d90cacf 4d1177e1e0 92137e93e7 bf5c0ff11b 1a81e81568d 11aaf91d931
18922c9bfba 1d68ad74405 a78bce4d95 10edea8ed9f 2f6bdf7c6e 1460858efb8 628b39bfa1 1c3215f60ab 18ea1a46e45
19bf64425e d310f81754 1710d4c011f 18a69b611f9 debbe1d511 2fbfefbb73 97f0e7392e ea0d6b3747 ee85459226
19f66c0749f 1db94352bd4 171dd78c628 cbba32d9b0 d5e371e1d0 137c3fca430 6ad97a92e9 12f79b381ef 59b998e941
b2e255ed67 13354c8c86 1aa40ef5488 b95adbcc0d 1d4897b2626 1166b9dfc1a 1784c28be7a 1015dab617 5ecb96cd36
81600554a2 1f48f1758cb 1102cad72f0 10f94a3df50 db38400c7e 1d29e72e330 59698d378f 167078aad77 48a99ecc6a
14c574abe4b 6fe03d48c3 1baf5decb77 12fdb9e349b 103664d422f 7599779f7a 1ee922cc3aa 16276782f89 37c979c3bc
cdba2dc35f 52f84ee994 1efe6aa735f 15a1639ed91 9e3a598da6 19a86ca9a9 970dadb02b d2d2239539 1b5a9a7d43a
1a28d711304 73027dc257 8697226ebb 91ab09256d be79f6ad45 1f077c5229 7854970278 d39af32496 195054ca9ac
1c1a949a25f 199873924c4 1847acc8563 4acd98a710 f04020319 14de092f710 305e1be573 15bd8fdc33a 15d07db004c
abd7e91181 8f5bd0f053 cbe19f767a 10be8ed0709 134b8d9b6ae 190e4ec260e 3bdcbca890 112372a27ed 1feb58f771
1c4cfbe06df dee5b17d82 1871a774e8f fd5def58a5 12ec074eb5f 6b55ac1c67 c5ffe47891 73b6ce69a7 66b0e0f585
100248623a3 16392f6f04 7d50747cb4 1e19f28f0ae 14f8084fd3b 18f1b547e66 d28e258b80 174de911918 cf50acb1ff
c8ee9466da d633674cfa 323c586885 1285f5a641a 1f6d00cf4d0 106da5ccee7 8020beacb9 1af2bb77ef3 7a2f69285
eab509d74b 170b3474645 5a4dae3dea 2c433626d2 19d15ffd4ea 1147744815f 15ddaf434a9 9025076210 939368b89b
1859a3a07e7 159db2909c6 16d8f3a0103 1905ea325b2 19381a115aa 1f9ea104107 1e79cd536c a9a3ac60e8 70d66cadb1
bc17a022c7 116da464f50 d83ca13b7d 9dcfec097c 1a3240bf4a1 11426b7932e 1acdf2b6bb1 c10683210d 7d7a7382be
5a6740670d 15b4c25f379 f3cb471e8b 1714233b4d7 b328dc549d 123e124ab06 c8d2af806c 19b6c8925ca 64f327983d
dc5a2e66d8 1df61d3d025 70fac19125 6617ff9162 1da1d9503ab 1ee6af25502 329c6d86ce 157e5f038e1 cc6dc97cac
24778a626b 138894bb342 7d6f002e55 4b9b4764cc a0cbc5d154 12aff498e59 1653b5202 149b66cdb7a 4cffaca152
2f69b2b280 aed4bffbb2 1dcf40a92c5 1d5606cfc4d 1d288445a1d a9a40a7a93 16c34dd7a7a e30c44e5dc e7596aeb7b
d8ec1e4dac 19acb07c581 1c59956a5de 5eb32fe0f7 d4f39ab374 41c0946c78 1a8ca1f2d3f 1aebd3c67f ed6dda9095
d4eb3edb9 7819d2a6ee 45b8f998fa 3c0201308a 1e0ffab3f53 1e6cc32a780 1045e550c09 83c4a6bfaa 22b798a1f7
f42f1fdb24 1bbfc9837f4 ce03a8c117 66b8746cea 534be8e3d1 37c5258685 ed86dea0ed 15ecb7ce911 1245834d414
c6ec052f56 9df26ab706 1e5d6eed381 675416f65f 7ee172ae2b 53bff79a11 1bfa2b53c01 1169abbdc78 1127893424a
128bd3ea4de 147e8cf6371 444d0b3b3f 5d2e9b8c8f 14ec21faf96 2a021b8364 188855bf812 168438f3dfc 1b3a7ea750d
1ff1a134379 10c8c199da7 ec9a724ddb 11f6a71c4d ad5318169e 1b156466b97 1846159b5ea 6d0af1b37f b7d5659b5f
163fadd70c5 1287c7ad5c8 f6df36dfb0 188bbbf3a19 14162619351 186af9c4e52 958ca4268 8044bb1794 71113e2ff4
1fc66211707 1827c740954 1ff95d06cc4 1b54ff685c1 6d88de7741 1c927e3eca8 42c6d5652b 1c28d92cb19 1b5779b48d9
1344e24a9ce 31b6b8c707 11c4a8eb4e2 1995b6d9d79 1193ac8315f 17f611bc3b2 9902c85dc7 10ca1728539 9a5bcf7b6
c875bfe3b9 1c80ee1752e b61b1b07e 1e4f7552473 141ae812d3a 992bdf44f2 177cb8203f3 cc54c9a54 12b5f0a47a0
117884a0232 bf7d50d7b6 4c6c3f6879 37a66b633f 10fd1a275ee 11e5790554c 15c168a72a3 13c7537eaba ca23dd9aea
12dbb51fc2a 14ae352eed0 20e166257f 11ce40d3d1e 10f4929db1b 19fd90a2f45 4ee5bb04b0 60b378e062 1c86c08e115
849e4e2de 1161e70e4cf 87d52000e4 1c0acc158ab 136f7d2d252 158c0d6986c 1174bd33519 5a72318656 d6e9d0f11f
188b6005e76 ecbb0ca621 1131eb3cde3 1de6369b749 153d9ccb5ac 6022a8be13 368ec83b60 1345506440d ae9863319e
d963623257 97fe23da88 1cb23403fe1 190a0c54bc2 585f248208 1be4b974e1f 571a78ba23 113f244d483 f8780c4818
db51a82200 16c49ec533a 1585317f190 1fc70105ed9 1ae4053905e 1dda20b1e04 14e06567fda 1fcf73cc8f6 ab374cf2e1
752720033a 4a6432e5dc 1c0f08cdd28 5eb87043f7 1ec38067d90 1fef4cf5059 1700dac4882 cdd792496 1994ef8c66
1669a978fac 93695c2811 8c84651653 1305144f59e 1e5597b1863 154d2615543 1e5a8c08afc 841f1b18ec 1476b7e29a0
10731c052f3 8744107d0d c61901934d ec347b7b88 e7476d701e 6e867aafb e1d03044bb 658319e530 14336373a0e
16cb93a933e 1b8b6d95bb4 4a5413171 10ff862197 1115f3202f1 1d6f7ed1430 1b373d7ff0f 25cfa73de1 cc6b38943a
759f924c6c 14862200a2c 1b74c7a4cb4 12d44b5851b ca97f5aeb9 4d36701f59 1de88f2493c 420abaa0f6 d892babdd5
62fe9b8b99 6a1c54d76e b87dde2e3b c77657afe3 6b72f09030 184b68bbaea 22a6cd479e 166f0c5ba7 1809f47bad3
18ed0cf68af 1ae1368afda ca2d646634 1320f49e286 d56c0385bd 6b6f80ffc8 b0615b2264 125287f0185 110b2bee8f
1e9004a8e70 15dde15e068 10438693ad9 15baa26fb1e 183bfc66070 804a41b38f 5dbd4a1a67 b10be90245 50b250494f
1dac323cc2 175a189df75 12ddf98fe04 10862cc7c48 1dc90b7cd4 11dbf851ad7 1a87ae5dc11 17f7fa9e215 13038ead8fe
1181bd7be69 119086a04d8 1589d569b98 1e9b00424f1 80ff1896e9 90d4c22245 1eaf9672f6 4afcdf31fa 145d412a4c3
ab19785bb1 1d96d082bbe 14286dce6ec 160fd92f8fb 12fdcb8b2af 1a01a3425da 133162849bf 17f312a577b a28b92bb72
18e5fbd6372 1df71ceacee 12c5bdf9515 e6c1acce21 9d25699cd2 15270b91c81 126e0bb0707 fdfae613f7 16e8679d842
1d2c9b489ad 1abd33e45cc 192f2c15d5d 1713ce8276c 10e56516b04 13739a4e4b7 76c27d6558 1eee4c41ee2 64d3c6c09b
15d2944dbe0 c61d6ba698 180dffc6541 15061fb4932 df6e885666 127eec246c8 19b51fd70c4 1187e4df717 6a8b0a8f1d
11942390170 a421965912 1f726d51351 317c4daa03 1acdc1ece78 3fd243f3eb fdc16c4efb 2f12371b10 39b6e20f1c
169ab733a9e fb398f0a72 2761cbddc4 d6a06bbcce 56f4927d58 c5a4372537 1b90381e8d6 91b9fae2d8 16ee910633b
a7bc7dd016 e725ab716a 18227cf3c37 dba6f91ce3 1fedfb8bf3e 15de02922d1 d11529aaa3 1a162d5f7f1 4b0b4d9d3e
6f50397572 1348ebcfc2e 9df43157d4 1999827f76a 1467f2570f3 1eba5dff8c1 10ee96b1e22 107be5eddbe 1411df497c3
d226a166c0 f3d092e815 58e2ed63ce 13bd7ba8df6 1298e4f35ce 11be9845c0d b53afc8ffa 67af688e82 10a41cd33d7
f6838baeab 777ac0858 1dfcd3f233b 34944e7100 12487a3b270 ec12b9190d 1bbc01a91c7 656b8c243b 4dbb62b088
13ab915c3fa 1f8a3d62167 9a46896a fb5f4d2fea 1116bc7e342 183e9fd5a14 1d0c98a1c5e 15d459676d3 f760f6f9a3
12c66e40456 173ddc771b1 7db0a1578 1f3ce6f5029 77d9f5679b 1ac5f85b64 4c672cd5d 15680655ee8 186876a1255
774469842e 13271af9a24 6e89c9fb2c 6c1d9e2be1 f0741acf5a 2aa8d88fee 38b16ed82 e9cba39dd7 912e6005cb 1251d6608a9
e0b6ff59fb e08ea95b44 14573ade1a2 15b7c8a4880 30578d9c9a 1fd9016e391 a0f6219300 d6556f9ac1 1c1012de94
b971893af5 11ca283b57b 10c64cb9e05 1aa714b75b4 14aca141713 125c7fabffd a981632be8 113c56a7e7a d2ba1957ef
160d918b563 fb8ce18705 7127d3be2c 12a325812ac a0ae4e4033 7a50e36769 c0f50d2c7 890ba241c 10b3a091b74 1dfa797966
1952caa9bad 9d825284d7 4ba9437737 1f33933c933 6d53c810e2 e4a1f020fb 152a41fc39d 1e6f1b3bd37 91ea70722f
28924a2a6d 1ec4fbfa9ab a989d49062 79387b2a25 54b2e53b73 14dc3868cf9 14b9d290525 b777ff6c35 9774746651
14c55cb6390 571a4688bf 312aa0996a 1532efa1a5c dfec4adedf 9681870c1a c30efd0321 1e872eec40 10aee5189e
1b54c11e3b0 1054076b18b 12009bab10f 1f5de648026 1fec2d089f6 1ae79a3d351 16055846033 14a18cf43cd 2b4868b059
f39d118add 184fa8a563b 5dcd75adef 1f867bca4ca 722f8230e0 1c7739a0b92 14d27afcac6 1ff4483a337 1ee3e7ec65e
15bdf9cf572 ac55b183d8 1bd7ba5eb7e 13d6f28d36d 94483a59c7 1971a6811fc 1d01f6dc8e5 1d7041a8164 cd4bb66307
3cc8bae5d2 40a28f0a0e 28ff942508 10f7db14df0 970a05aa25 4a714b291e c701e4e2e9 c3311c809 85c5af52eb d2a0ddcc3b
1b86f410788 1ede3484ca6 4074091b8a cdace8c340 964a817ec7 53c4b1e08a 71f3cfaffd 1c847b0f581 1f95bfc003b
1c86666096 448e6a5caf 17d9562fe30 14b11e2c939 146ba94fe60 13917b4bc7c 1bfab5951e7 19279b20f95 216bd36a1b
17888e39bb5 ae80792a03 8298ab4acb 10dfed49850 cb166c8a85 101beba4048 855cff4fc0 1849168c1c5 10a38f62987
49cf1f189b 16a2876af49 87fa6e2a56 62c7b015c2 d5c29bc4a1 62091756ed 518e01968d 3d09d83c3a 54f111c2e2
1555bb741cd 9dbccd3073 1ec92ece825 112998bc8 e02379d7c8 149f696fd0f 1b7137d7768 1a3b030519c 1e1d806bfcd
bc65b06e8 1983059408a 1e9fe1feca9 132c0a95aa a6dc5119e7 fd58b2db10 137e20c98e5 968688531c a81dc892a8
f861cd9997 1b0d2b12efb bea34e27 db665c24f9 e90e722940 106d989a38 2e84aac68e f3e4a70319 1d9d002369b 1c31c31105
91514c5856 1c49b1c053b 1ebef82c4a5 1ec86920675 1253eb1b8cf 19c293afdd8 1e6a30fc496 1cf75469e1 1216b1b956c
6dc53cf47c 16b338cb908 7bc89831bb 12bfceaee52 602827afa6 129bef4e086 19ade8a837b 8f365a39dc 13331a3ed5d
167bf567e12 1817eb5403d 116a0ac445b 151f5a1ae96 355fbafed3 1721a856f18 398c5fb690 18fde252209 9bc1effd8d
15e058368cb 1ef19f8672d efeb28bcb5 8597fe8243 1e3558b7241 1f06d2b5a4d 6753166ca7 19d05252f87 7ece8719c7
abada7be10 3b7bae0915 b920dbfa1e 77c3d750ef c8a77b91e5 13c12511766 1bd655e970d d5f0a10e67 5c151f0386
f36c123216 733590bd56 134800baf0 166cf1de51f 117dd06e881 129a0921efb a6ff0ca5c4 8ea200b050 34f9387b94
1d3723ad2de 18e5af2b62e 10bd979c6df 14d339607a4 1b88544514a 3a4450d2d8 1a61117a18f 1e21725e539 123cf7364fd
179908b5b01 69ec91a349 945679ec02 e6a4ca1b53 7e2c612da0 1f568f32763 1b564f98a0f 20e11f4d89 90c3ea1433
14c7e71acd3 dc4e4b061f 1c813886671 998741f58b fe30e80a8f 607de6a503 1484657259d e53c335255 174d9bd2dc8
7d39cfa317 1c0992c6850 112351c0a60 1e0d5e6cd44 667998400c 42dfaef259 19abbd3ed08 14ad9c7ab72 56389ff426
19427c1236c 1a4063a9d61 af87f97b4d 1666612b513 1f23ac539e4 1e873a1cf84 1701f1aeddc 18b22a98565 1ddc760ab43
22da169d55 f1416893de ee14c0e6db 19252aae1f5 b4fb6141d c2b99da72c 19ec587f23a 1f44dc5cd77 101573c5f0c
c8590ac48f 1f1d4b1d98d 12ae39c0c1e 16e46996bb3 d907071ae1 ee89247a5b 12753bfdbce 7906c2f180 6632db9a04
6dd60d443f 6b859327f2 18f08bb0ad5 100dd9d760a 1e8c644d0d 1e8edb740dc 16ba7ffa32e bfbda5d84c 17fdf137ad8
777ffe01db 13b9a93d0a6 32bde748a4 104f87c4ba8 1102e5438a0 1790599f8b8 6e0e97a55c 980d898e6b 14035825c86
199ded7a4bf 138ab0050f4 f8c1940dda 129ad4d2a65 76a9aca541 1332c5d323c 1dba5113a26 1c66d9f5293 17e232d0d9a
9976915862 1913b2a7244 b2ba534e99 160d1bf0cf7 eb9922d30 2e3f788035 1d158a6dfbe 14e9413f1fe 132d8c19753
14b4f73c0c3 1f33b28cfd 72a8fad428 1514364455c 2d98ab517f 167cedc2d26 1bb3c039f02 144f9f06518 86d324dd1c
12c4eb26f57 78ea843219 6a55f7e6b6 6d7b34c6e0 1016cfeb2ec 4215676871 156b12b4c31 586fdbe5d9 30212d8b7b
1cc7382e8cd 6ca5a2d1ec 875c7a96f2 1710b90c031 10d1d8c47a 1bf01e51bb9 c1793e8778 1b326c2d7e2 c5310a5aab
11cd7b3c8e5 18d5912ebaa 17450d723c4 ab2fa34dcd 12c7246a7bc 1b365296a34 c47f954743 50467ba354 2cc0b816e1
17598c4f17d 1af4283647b 5a5d5379ec 1aaecddc00d 1325e99894f 3935af6226 18450e1eebe 9adfe3a3d0 79383c9291
2212102d63 153d2be7427 fb53f1bb55 918bed2982 10f53f0d799 526ff4d1b3 bc90635acd 1453b55ba1d 1079d69bec4
1af3934bd83 b29697fc3f 108533de8dd 12968f67594 11cbe9cb3ed bac4e20c3 134251aba54 14eaaa20df5 1528aec9718
170983cc1ec 2f097e68c8 5f746b9d5c 1ca56b310f3 3972530948 9ba80f3bce 16c5f86f30d 119664abd83 16fdda25a23
17631d1a1d3 3d72d2b20d 11f52f5697b 1d6b6d864f 43d6422f0a 16ef1aa2e0c e1a3790b11 f1667a531d 11cc7bbbcda
1ace1b03f19 18bd83b1d52 8a5de68db4 18fbf08cfef 82019639cc ab6b9a8d3b 1fc4a838fba 104f0d67db1 1e4bd144895
10493faac76 6f1ac45d00 1b845ac503 1a071baaaef 17ce5822109 1a7b9992deb 1641ad2afd1 1983f74b6ee 11dd4491184
1597809c70c 1c9ee207a02 1fb967dbcce 13dd5d0740 1f04a7cf90a bda526f2c0 a290afad5 1f74ef5e0ed ad155bc8de
8a74e0d64 1e26d6d2095 1efe9d3f3fe b7bb790080 e83eb7940b 195a6721de 1697162ecc6 1a822424ecc bb9409ef14
88dc8af7de 1a109fbdf8 1263a6224e1 19762451a46 123f8087a5d 1ee61da2ff8 1050f8b67b3 5bd05e0ad3 17f3054510b
1f0a65cbe49 c38f39ecfb 1b186adf1ca 3c9d6cb25 b0d33343b8 8cb15b5077 83960895dd a4f544f26c 14637fba5b5
c8a7c5184d 109ef503b91 110cc27f58c 1dd15e9f124 1eddb2ca0d9 aafbfcea5b 3f14f93014 1c8249b99d9 7c3667f5b3
1a62b640f70 1eec6a22d2a 855be93f97 c7af091027 10a7ffe2790 1042e09ea4c 76db25a8e1 1654d706d3f 260b3a5e33
88f9419e9e 1d68917df54 1188549820d 158d48169b9 19e93fcdd73 16b91a47690 1fba468bd65 bb64a6d60f 157432e4097
88a4f70f06 f091d83cf0 1c4a6fbc192 ada88c3e7d e531e141b5 1237b66171c 12749c7c2f4 e2cee269f9 260340689f
19500504a28 14432099794 47cbdd04d3 1af023fdbe 1eee99e354e 12649e3aff 1a7f7a49cbf e43793e465 6209ca0402
1eadfe92cff 3dacced0bc 97a15758c0 1fcd58aeaae ff774c923f 7a5654482c 1b492028846 15c12bf403f 1e7575219b9
342bb31b5c 1a8052db35e e8274ad0db f1a937c8a 94b5e48ed7 352cb6ab16 15cff6a6f12 1ee40155a64
"""
