"""Layouts of tables that pages share."""

from corvane.sources import office


def test_pages_with_the_same_tags_share_a_layout(monkeypatch):
    """Pages of one form are laid out once; what only the parser can read goes to it, and gives the same."""
    made, layout = [], office._layout
    monkeypatch.setattr(office, "_layout", lambda tags: made.append(tags) or layout(tags))
    office._known.clear()
    form = "<TABLE><tr><th>a{0}<th>b</tr><tr><td rowspan='2'> {0}<br/>x &amp; <b>y</b></td><td>{0}</td></tr><tr><td colspan=2>z{0}</td></tr></table>"
    for k in range(50):
        (table,) = office.html_tables_of(form.format(k))
        assert table == {"name": "0", "headers": [f"a{k}", "b"], "rows": [[f"{k} x & y", str(k)], [f"{k} x & y", f"z{k}", f"z{k}"]]}
    assert len(made) == 1
    for odd in ("<table><tr><td>a <!-- <td>b --></td></tr></table>", "<table><tr><td><script>if (a<td) {}</script></td></tr></table>", "<table><tr><td>1 < 2<td x = 1>&lt;</table>", "<table><tr><td a='>'>b</td x></tr>"):
        parser = office._Tables()
        parser.feed(odd)
        parser.close()
        assert [[t["headers"], *t["rows"]] for t in office.html_tables_of(odd)] == parser.found
