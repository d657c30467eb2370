from codeloom.llm.handwritten import evidence, header


def test_notice_below_a_long_licence_comment_is_seen():
    words = ["terms " * (i * i % 23 + 1) for i in range(80)]  # no shape repeats
    licence = "/*\n" + "".join(" * " + w + "\n" for w in words) + " */\n"
    assert evidence("c", licence + "// Code generated by protoc. DO NOT EDIT.\nint x;\n") == "generated"
    assert evidence("c", licence + "int x;\n// Code generated by protoc. DO NOT EDIT.\n") is None
    assert header(licence + "int x;\n// after the code\n").count("\n") == 81
