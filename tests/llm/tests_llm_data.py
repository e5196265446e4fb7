"""Rows with null, empty, repeated and very long values."""

# A null id and text, an empty text, a text of breaks only, a repeated row, a tie in the id, a long text.
ODD = [(None, "no id here at all, friend", "x"), (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "same words again", "x"),
       (4, "same words again", "x"), (4, "another text with the same id", "x"), (5, "one", "x"),
       (6, " ".join(f"word{i % 97}" for i in range(60_000)), "x"), (7, "Ünïcode ’quotes’ 漢字\r\nand lines", None)]
ODD_SCHEMA = "doc_id long, text string, words string"  # an extra column whose name operators use inside
