"""Digests of whole outputs."""

import pytest

from tests.fixtures import (
    BOUND, BOUND_FA, BOUNDS, BOUNDS_TAGS, ENDS, ENDS_TAGS, LEFT, NAMED, NANOPORE, NANOPORE_TAGS, POLY, POLY_TAGS, RIGHT, SPLIT, SPLIT_TAGS, TERM, TWO, md5, run,
)

#: fixed values: options of the cases and the digests of their outputs
_PAIR = dict(groups="t,t,b,b,b", tags="GATACT,TAGAGAA,CCGG,AACC,AAAAACC")
_FIX = dict(distances="1,1,1,1,1", locations="0:0:10,0:0:10,0,0,0")
_PREV = dict(previous=",,{{t}}14-14,{{t}}14-14,{{t}}14-14")
_SAM = dict(sam_tags="AB:G:,XX:X:,FS:D:,JKL")
_LONG = dict(subs="TTTTTTTTTTTTTTT,GGGGGGGGGGGGGGG,GG,GG,GG", distances="1,1,1,1,1")
_SHOW = dict(x_names=True, seq_names=True)
_ASSIGN = dict(assign=True, no_outb=True, com_names=True, **_SHOW)

CASES = [
    ("through", [TWO], dict(), "cb52b79ed7469ca2ffe5739ec544b157"),
    ("qtrim3", [TWO], dict(qtrim=10, qtrim_3=True), "0284bb3b6fa601d6f85d8d051f7e6431"),
    ("qtrim53", [TWO], dict(qtrim=10, qtrim_5=True, qtrim_3=True), "0284bb3b6fa601d6f85d8d051f7e6431"),
    ("qtrim5", [TWO], dict(qtrim=10, qtrim_5=True), "cb52b79ed7469ca2ffe5739ec544b157"),
    ("naive10", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_naive=True), "3b25d6c8a52ad921c4f6565ac7b1b299"),
    ("naive11", [TWO], dict(qtrim=11, qtrim_3=True, qtrim_naive=True), "3b25d6c8a52ad921c4f6565ac7b1b299"),
    ("naive12", [TWO], dict(qtrim=12, qtrim_3=True, qtrim_naive=True), "903366847aa3aa415250f57d83f5517d"),
    ("naive5", [TWO], dict(qtrim=10, qtrim_5=True, qtrim_naive=True), "cb52b79ed7469ca2ffe5739ec544b157"),
    ("phred64", [TWO], dict(qtrim=8, qtrim_3=True, qtrim_naive=True, phred64=True), "f03fb0cee9154be006dfccd5f67797f6"),
    ("umi_post", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_naive=True, extract="0:2<umi1>0:-1"), "c2b7cb4efdf7e5454065c040f7d68eda"),
    ("umi_pre", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_naive=True, qtrim_pre=True, extract="0:2<umi1>0:-1"), "901db158c199d263fb255700f890c4d3"),
    ("umi_pre_sum", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_pre=True, extract="0:2<umi1>0:-1"), "b528297482c1a2e4da30d7bb374cbb2a"),
    ("umi6", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_naive=True, extract="0:2<umi1[6]>"), "b6b0ff882387c2ada3cbed8757a40290"),
    ("umi6_pre", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_naive=True, qtrim_pre=True, extract="0:2<umi1[6]>"), "cdf3d28488e3b6feb23efbe104281684"),
    ("umi6_sum", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_pre=True, extract="0:2<umi1[6]>"), "c883d391b1d4c20deac071f7f7af1905"),
    ("umi3_sum", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_pre=True, extract="0:2<umi1[3]>"), "eca2afc5392b2c6006cc3ed1a9c993e8"),
    ("trim5_umi", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_pre=True, extract="0:2<umi1>0:-1", trim_5="1"), "3d4f688a7a742d7cf80d1fe196c6f8f6"),
    ("fill4", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_pre=True, trim_5="4", empty="ATCG"), "4cdf8aa6f1767a22ad8c09e38fe2118b"),
    ("fill5", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_pre=True, trim_5="5", empty="ATCG"), "1b5a09bd343382ee78c9aa51245557c2"),
    ("long", [TWO], dict(qtrim=10, qtrim_3=True, filter_len="5"), "b0e38a846bb762767fcfa6ca002a7cab"),
    ("short", [TWO], dict(qtrim=10, qtrim_3=True, filter_len="0:4"), "ba907ffe8c0e14a57043a926f3ebce6b"),
    ("trim53a", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_pre=True, extract="0:2<umi1>0:-1", trim_5="1", trim_3="3"), "de9dbc2094d559c5c8ff8e3a7ef45d0b"),
    ("trim53b", [TWO], dict(qtrim=10, qtrim_3=True, qtrim_pre=True, extract="0:2<umi1>0:-1", trim_5="1", trim_3="2"), "3d4f688a7a742d7cf80d1fe196c6f8f6"),
    ("trim53c", [TWO], dict(qtrim=10, qtrim_3=True, extract="0:2<umi1>0:-1", trim_5="1", trim_3="2"), "ea3d6c48d6781609beb6993a82e20a7b"),
    ("partial5a", [TWO], dict(tags="CCAAA", partial5="3:0.35", left="1"), "b637fbabe71eb90bb9b3399a17eabef7"),
    ("partial5b", [TWO], dict(tags="CCAAA", partial5="3:0.34", left="1"), "b637fbabe71eb90bb9b3399a17eabef7"),
    ("partial5c", [TWO], dict(tags="CCAAA", partial5="3:0.33", left="1"), "cb52b79ed7469ca2ffe5739ec544b157"),
    ("partial5d", [TWO], dict(tags="CCAAA", partial5="4:0.34", left="1"), "cb52b79ed7469ca2ffe5739ec544b157"),
    ("partial5e", [TWO], dict(tags="CCAAA", partial5="2:0.34", left="1"), "b637fbabe71eb90bb9b3399a17eabef7"),
    ("partial53", [TWO], dict(tags="CCAAA,CCGGAA", partial5="2:0.34,", partial3=",4", left="1,0", right="0,1"), "93f1726415edb410d5e733603bc4be11"),
    ("partial3", [TWO], dict(tags="CCGC", locations="0:-4:0", partial3="4:0.25", right="1"), "11b55a195b5976331305569416db5bd4"),
    ("partial3_two", [TWO, TWO], dict(tags="CCGG,CCGG", ids="a,b", locations="0:-4:9,1:-4:10", partial3="2,2", right="1,1"), "6807e3ba911fde8fb437f693d055c11f"),
    ("next", [TWO], dict(tags="CCGC,GAAG", next=",{CCGC}", previous="{GAAG},", locations="0:-4:0,", partial3="4:0.25,3", partial5="4,3", right="1,0", left="0,1"), "93f1726415edb410d5e733603bc4be11"),
    ("next_none", [TWO], dict(tags="CCGC,GAAG", next=",{CCGC}", previous="{GAAG},", locations="0:-4:0,", partial3="4:0.25,3", partial5="4,4", right="1,0", left="0,1"), "cb52b79ed7469ca2ffe5739ec544b157"),
    ("next_free", [TWO], dict(tags="CCGC,GAAG", next=",{CCGC}", locations="0:-4:0,", partial3="4:0.25,3", partial5="4,4", right="1,0", left="0,1"), "11b55a195b5976331305569416db5bd4"),
    ("sam", [LEFT, RIGHT], dict(**_ASSIGN, keep_grp="t,b", **_PAIR, **_FIX, **_PREV), "53a53635d0ad34937feaca1f2aa8ae5d"),
    ("sam_own", [LEFT, RIGHT], dict(**_ASSIGN, keep_grp="t,b", **_PAIR, **_FIX, **_PREV, **_SAM), "fd979c64c21eb530e3fb8eb964efac25"),
    ("sam_far", [LEFT, RIGHT], dict(**_ASSIGN, **_PAIR, distances="0,0,1,1,1", locations="0:0:10,0:0:7,0,0,0", previous=",,{{t}}14-14,{{t}}15-16,{{t}}15-16", **_SAM), "6620fed5ace9d1a1a85a51065d5b0c11"),
    ("subs_own", [LEFT, RIGHT], dict(**_ASSIGN, keep_grp="t,b", **_PAIR, **_FIX, **_PREV, **_SAM, subs=".,.,.,.,."), "8e9a69d297d492cbfe054004666efa44"),
    ("subs_own_free", [LEFT, RIGHT], dict(**_ASSIGN, keep_grp="t,b", **_PAIR, **_FIX, **_SAM, subs=".,.,.,.,."), "078e57e27856ccb38ca751a9a832bfc3"),
    ("subs_all", [LEFT, RIGHT], dict(**_ASSIGN, **_PAIR, **_FIX, **_SAM, subs=".,.,.,.,."), "05940a828e3dbfbd8a0c44f9b375abb6"),
    ("subs_keep", [LEFT, RIGHT], dict(**_SHOW, keep_grp="t,b", **_PAIR, **_FIX, **_PREV, subs="TT,GG,GG,GG,GG"), "47191e11ace788948cea359400a66b55"),
    ("subs_plain", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_FIX, subs="TT,GG,GG,GG,GG"), "1ef6f5045ebd99f29afae768ecbf79f3"),
    ("subs_delete", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_FIX, subs="TT,-,GG,GG,GG"), "c2abb7ce085324c0bbb89ae9f01dd85d"),
    ("subs_repeat", [LEFT, RIGHT], dict(**_SHOW, tags="GATACT,TAGAGAA,CCGG,AACC,AAAAACC,T:5-11", distances="1,1,1,1,1,0", locations="0:0:10,0:0:10,0,0,0,1", subs="TT,GG,GG,GG,GG,-"), "6b3e2fb7655a14b08cddf7effd5f27e8"),
    ("polymers", [LEFT], dict(**_SHOW, tags="T:5-6,C:3-100,A:1-5", subs=".,-,-"), "8cc70e8d1a5bf62d602c38558ecbd725"),
    ("polymers2", [LEFT], dict(**_SHOW, tags="ACAC,C:5-100,A:1-5", subs="-,-,-"), "3bb7150085b56c492f58d6112e234bd5"),
    ("unit12", [LEFT, RIGHT], dict(**_SHOW, tags="GATACT,TAGAGAA,CCGG,AACC,AAAAACC,AC:1-2", distances="1,1,1,1,1,0", locations="0:0:10,0:0:10,0,0,0,1", subs="TT,GG,GG,GG,GG,-"), "b6d90e8d48b3bd9c6939c8b095b18804"),
    ("unit2", [LEFT, RIGHT], dict(**_SHOW, tags="GATACT,TAGAGAA,CCGG,AACC,AAAAACC,AC:2", distances="1,1,1,1,1,0", locations="0:0:10,0:0:10,0,0,0,1", subs="TT,GG,GG,GG,GG,-"), "83d5094e21e3044c9e8ea03e13aac2cd"),
    ("unit2n", [LEFT, RIGHT], dict(**_SHOW, tags="GATACT,TAGAGAA,CCGG,AACC,AAAAACC,AC:2", distances="1,1,1,1,1,0", locations="0:0:10,0:0:10,0,0,0,1", subs="TT,GG,GG,GG,GG,NNNNNNNN"), "d5f194caf779d8a1fd0aa59bb9fe8eae"),
    ("subs_prev", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, distances="1,1,1,1,1", **_PREV, subs="TT,GG,GG,GG,GG"), "4d8a551a84d4d10b7deac330227616cc"),
    ("long_q5", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_PREV, **_LONG, qtrim=30, qtrim_5=True, **_SAM, limit=2), "622e99643d60536a6ee99f9d968ac20f"),
    ("long_q35", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_PREV, **_LONG, qtrim=30, qtrim_3=True, qtrim_5=True, limit=1), "91071e8bbcecbad10599a7d8ebd3815c"),
    ("long_pre", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_PREV, **_LONG, qtrim=30, qtrim_5=True, qtrim_pre=True, **_SAM, limit=2), "901358fbfe41d20a9b4dd99fbac22866"),
    ("long_pre3", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_PREV, **_LONG, qtrim=30, qtrim_5=True, qtrim_pre=True, trim_3="2,1", **_SAM, limit=2), "e1dbf41e8fbc3b9919834a241feb9bb8"),
    ("long_53", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_PREV, **_LONG, trim_5="3,2", trim_3="2,1", **_SAM, limit=2), "26c827664525506605c10cbfe6ce8566"),
    ("long_left", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_PREV, **_LONG, limit=3, left="1:1,1,0,0,0"), "867987cdb5a7fec25ae37f6d2742aafd"),
    ("long_lefts", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_PREV, **_LONG, limit=3, left="1:1,1,1,1,1"), "dd3e052e2383110ae6fbfb256496efe2"),
    ("long_filter", [LEFT, RIGHT], dict(**_SHOW, **_PAIR, **_PREV, **_LONG, limit=3, left="1:1,1,1,1,1", qtrim=30, qtrim_5=True, filter_len="1,1"), "7e6de423bcff3285977a599530e0e1fd"),
    ("umi_tag", [LEFT], dict(ids="bc1", tags="AAAAAGCCCC", distances="1", x_names=True, extract="<~umi1{bc1}>"), "51e0dc9135b51a3ec7399882913ccb99"),
    ("umi_sub", [LEFT], dict(ids="bc1", tags="AAAAAGCCCC", distances="1", x_names=True, subs="ATC", extract="<~umi1{#bc1}>"), "56a0fb91eb32570b511e0c9525263a3a"),
    ("umi_read", [LEFT], dict(ids="bc1", tags="AAAAAGCCCC", distances="1", x_names=True, extract="<~umi1{@bc1}>"), "f6f26e1d302c7db0534eb0a7d9b67ad4"),
    ("umi_chain", [LEFT], dict(ids="bc1", tags="AAAAAGCCCC", distances="1", x_names=True, extract="<~umi1{@bc1}>,<umi2{bc1}>,<umi1[3]>{bc1}"), "abcd9afb0fd8916c9156c13bfeffde32"),
    ("umi_tags", [LEFT], dict(ids="bc1", tags="AAAAAGCCCC", distances="1", x_names=True, extract="<~umi1{@bc1}>,<umi2{bc1}>,<umi1[3]>{bc1},<umi3[3]>{bc1}", sam_tags="CB:Z:,RX:Z:/RY:Z:"), "ee0c21c4c2fe221742cd13b1317dd446"),
    ("umi_all", [LEFT], dict(ids="bc1", tags="AAAAACCCCCG", x_names=True, extract="0:0<umi1[5]>,<~umi2{@bc1}>,<~umi3{*}>", no_x_out=True, sam_tags="CB:Z:,RX:Z:/RY:Z:/RZ:Z:,BI:I:"), "b7cb8dd7e44b34f07f66ea3b3a9e7504"),
    ("umi_group", [LEFT], dict(ids="bc0,bc1", tags="TACT,AAAAACCCCCG", groups="a,a", x_names=True, extract="0:0<umi1[5]>,<~umi2[4]{{a}}>,<~umi3[15-25]{*}>", no_x_out=True, sam_tags="CB:Z:,RX:Z:/RY:Z:/RZ:Z:,BI:I:"), "f06262837c002c9e37e28535d2a617ae"),
    ("umi_sub_all", [LEFT], dict(ids="bc0,bc1", tags="TACT,AAAAACCCCCG", groups="a,a", subs="AA,TT", x_names=True, extract="0:0<umi1[5]>,<~umi2{{a}}>,<~umi3{#*}>", no_x_out=True, sam_tags="CB:Z:,RX:Z:/RY:Z:/RZ:Z:,BI:I:"), "4cb0d9c554a74b9075060ce6c2e705e9"),
    ("umi_read_all", [LEFT, LEFT], dict(ids="bc0,bc1", tags="TACT,AAAAACCCCCGC", distances="0,1", groups="a,a", subs="AA,TT", x_names=True, extract="0:0<umi1[5]>,<~umi2{{a}}>,<~umi3{@*}>", no_x_out=True, sam_tags="CB:Z:,RX:Z:/RY:Z:/RZ:Z:,BI:I:"), "3cf1eec93700913db553718a7440df03"),
    ("bounds", [BOUND], dict(tags="GAG", mod_names=True, locations="0:-40:0", right="1", extract="0:1<umi[4]>"), "77cc980d9f76c9511506db0263a07a1f"),
    ("ambiguous", [BOUND], dict(tags="AT,TT", loc_names=True, distances="1", mod_names=True), "432d31a38782e90fc8129c0d72e92d16"),
    ("same_name", [BOUND], dict(tags="AT,TT,GGGGG", ids="a,a,b", loc_names=True, distances="1", mod_names=True), "ca97fa58494f66bd3395ac329e5a95cf"),
    ("all_one_name", [BOUND], dict(tags="AT,TT,GGGGG", ids="a,a,a", loc_names=True, distances="1", mod_names=True), "ca97fa58494f66bd3395ac329e5a95cf"),
    *[(f"delta_{i}", [BOUND], dict(tags=t, distances=d, min_delta=m, mod_names=True), want) for i, (t, d, m, want) in enumerate([
        ("AGG,ACC", "2", 0, "08a1669f62d83b7726d562be030f44b4"), ("AGG,ACC", "2", 1, "af972eebe3b6e9366dacda3c0902af82"), ("AGG,ACC", "2", 2, "af972eebe3b6e9366dacda3c0902af82"),
        ("ATGAGA,GGGGGG,ATGACC", "2", 0, "decb5f9ccbd1300e9b89a78b52fc9228"), ("ATGAGA,GGGGGG,ATGACC", "2", 1, "40e7d95afa0ffa0fc483fc87f0c8a998"),
        ("TGAGC,TGAGA,TGAGG", "1", 0, "40e7d95afa0ffa0fc483fc87f0c8a998"), ("TGAGC,TGAGA,TGAGT", "1", 0, "588c7374ce94f3e07d94b5630a9c3f4e"), ("TGAGC,TGAGA,TGAGT", "1", 1, "40e7d95afa0ffa0fc483fc87f0c8a998"),
    ])],
    ("bclen", [BOUND], dict(assign=True, tags="AT,TT", distances="1", mod_names=True, bclen=15, bc_names=True), "9e7b7980f24349c5c334e1fc02950af8"),
    ("fasta_in", [BOUND_FA], dict(tags="AT,TT", loc_names=True, distances="1", mod_names=True), "ec7150e2b71fcf683ed80a3013e7c203"),
    ("fasta_in_names", [BOUND_FA], dict(tags="AT,TT,GGGGG", ids="a,a,b", loc_names=True, distances="1", mod_names=True), "8d701ebb09497ab0a3031e22b3ebf8a0"),
    ("fasta_out", [BOUND_FA], dict(fasta=True, tags="AT,TT", loc_names=True, distances="1", mod_names=True), "3458061c02f7a942a1b4eddf47d5bd7a"),
    ("fasta_out_names", [BOUND_FA], dict(fasta=True, tags="AT,TT,GGGGG", ids="a,a,b", loc_names=True, distances="1", mod_names=True), "5295712caa2eab75f1464c3a6da88be8"),
    ("chain", [BOUND], dict(x_only=True, config="@extract 0:0<x[2]>,0:2<x[2]>\n@trim-5 1\n@extract 0:3<x[1]>\n"), "2a90d56a5351db47f9ce0631e49693cf"),
    ("no_chain", [BOUND], dict(x_only=True, config="@extract 0:0<x[2]>,0:2<x[2]>\n@trim-5 1\n@extract 0:3<x[1]>\n@no-chain\n"), "f754cbd7b7ae2d64727c3a59458195de"),
    ("no_chain_y", [BOUND], dict(x_only=True, config="@extract 0:0<x[2]>,0:2<x[2]>\n@trim-5 1\n@extract 0:3<x[1]>\n@extract 0:0<y[1]>\n@extract 0:3<y[1]>\n@no-chain y\n"), "bf3e76244f949cef56abb020f826194a"),
    ("no_chain_xy", [BOUND], dict(x_only=True, config="@extract 0:0<x[2]>,0:2<x[2]>\n@trim-5 1\n@extract 0:3<x[1]>\n@extract 0:0<y[1]>\n@extract 0:3<y[1]>\n@no-chain x,y\n"), "60af71efc566e7dbb844a0076fb58044"),
    ("lengths", [TWO], dict(mod_names=True, tags="TCCT,TCCC,TCCA,TCC,TCCGG,AAA", previous=",,,{AAA},,", locations="0:0:5,0:0:5,0:0:5,0,0:5:10,0:5:10"), "a2df9f98d58b47aa1beeebabc835b3b3"),
    ("remove", ["@read1\nAAA\n+\n;;;\n"], dict(mod_names=True, fasta=True, config="@remove:\ntag1\n\nid tag\ntag1 AAA\n"), "d41d8cd98f00b204e9800998ecf8427e"),
    ("encode16", [f"@read1\n{'A' * 16}\n+\n{'A' * 16}\n"], dict(bclen=30, mod_names=True, fasta=True, config="@assign\n@barcode-encode " + ",".join("X" * 16) + "\n\ntags groups\nA X\nT X\nC X\nG X\n"), "6c300074e39d272b4fee6a75fae3e8b4"),
    ("prepend", [BOUND_FA], dict(extract="0:1<^AAA^umi[3]>"), "5827f14f608ed69bd38b12602c8fdeea"),
    ("append", [BOUND_FA], dict(extract="0:1<~^^CGC^^umi[3]>"), "20b95054c5a91cfeb8585c550570bbe1"),
    ("from_name", [NAMED], dict(from_name="0,0,2,::"), "e0b141cd0e6348d3cd64d23d61f67d09"),
    ("from_name_two", [NAMED], dict(from_name="0,0,0,::;0,0,0,::+", tags="GTTTA", distances="1", revcomp="1", mod_names=True), "83b2f368aea4e889ad5995dbaef6f744"),
    ("random", [NAMED], dict(random="0,2,25"), "669d8dbda3e81f74159e1ce280686d49"),
    ("random_umi", [NAMED], dict(extract="<umi{:}>", random="0,-1,25"), "30b84f54f195c1e499cafb33acb1b2bf"),
    ("name_umi", [NAMED], dict(from_name="0,0,-1,::;0,0,-1,::+", extract="<umi{:}>,<umi{:}>"), "21f22aeb47e01c059f957fddb28a01aa"),
    ("name_umis", [NAMED], dict(from_name="0,0,-1,::;0,0,-1,::+", extract="<umi{:}>,<umi2{:}>"), "c5456433bca2f5599d15f0785637149e"),
    ("budget", [TERM], dict(assign=True, mod_names=True, groups="PART,RPM,RPM,ODD,Y", ids="Part,RTBC2,RTBC4,Odd2Bo1,NYBot1_Stg", tags="TGACTTG,TTTTTTT,GGGGGGG,TTCGTGGAATCTAGC,TATTATGGT", maxfinds_g="Y:1"), "79ad1ca9184b274e1396b5f2220cbade"),
    ("nanopore", [NANOPORE], dict(assign=True, no_outb=True, mod_names=True, config=NANOPORE_TAGS), "86479a52fd7d35a1d0fcb62c5dbde424"),
    ("split_pool", [SPLIT], dict(loc_names=True, fasta=True, config=SPLIT_TAGS), "a4508f24c69838b07cec04978def09ca"),
    ("nested_lengths", [BOUNDS], dict(loc_names=True, fasta=True, config=BOUNDS_TAGS), "200fb9106e47c741b1891e4b2fedef05"),
    ("poly_lengths", [POLY], dict(loc_names=True, fasta=True, config=POLY_TAGS), "4caa199550f26000ac787821cc62668c"),
    ("poly_ends", [ENDS], dict(loc_names=True, fasta=True, config=ENDS_TAGS), "209698dea910ed4d4cd05dbce0889800"),
]


@pytest.mark.parametrize(("texts", "options", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_digest(spark, tmp_path, texts, options, want):
    streams, _ = run(spark, tmp_path, texts, pipe=True, **options)
    assert md5(streams.get("pipe", "")) == want, streams.get("pipe", "")[:2000]
