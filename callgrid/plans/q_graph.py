"""I and K06: call graphs."""

from pyspark.sql import functions as F

from ..operators import graph as g
from .catalog import register

E = """, ed AS (SELECT least(a_party_number,b_party_number) AS src, greatest(a_party_number,b_party_number) AS dst, count(*) AS weight FROM cdr WHERE a_party_number<>b_party_number GROUP BY 1,2),
 bw AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed), nd AS (SELECT src AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM bw GROUP BY 1) """
TRI = E + ", tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, x.weight+y.weight+z.weight AS calls FROM ed x JOIN ed y ON x.dst=y.src JOIN ed z ON z.src=x.src AND z.dst=y.dst) "


def _e(t):
    return g.edges(t.cdr)


register("I01_contact_graph", lambda t: g.heaviest(_e(t), 200), E + "SELECT * FROM ed ORDER BY weight DESC, src, dst LIMIT 200")
register("I01_graph_nodes", lambda t: g.nodes(_e(t)), E + "SELECT * FROM nd")
register("I02_degree_centrality", lambda t: g.degree_centrality(_e(t)), E + "SELECT node, degree, round(degree/((SELECT count(*) FROM nd)-1),6) AS centrality FROM nd")
register("I03_betweenness", lambda t: g.betweenness(_e(t)))
register("I04_pagerank", lambda t: g.pagerank(_e(t)).withColumn("rank", F.round("rank", 6)))
register("I05_closeness", lambda t: g.closeness(_e(t)))
register("I06_communities", lambda t: g.communities(_e(t)))
register("I06_modularity", lambda t: g.modularity(_e(t), g.communities(_e(t))))
register("I07_bridges", lambda t: g.cut_points(_e(t)).where("kind = 'bridge'"))
register("I08_cut_points", lambda t: g.top_cut_points(_e(t)))
register("I09_brokers", lambda t: g.brokers(_e(t)))
D = ", dp AS (SELECT a_party_number AS a, b_party_number AS b, count(*) AS n FROM cdr WHERE a_party_number<>b_party_number GROUP BY 1,2) "
register("I10_one_way_ties", lambda t: g.one_way_ties(t.cdr), E + D + "SELECT * FROM dp x WHERE n>=3 AND NOT EXISTS (SELECT 1 FROM dp y WHERE y.a=x.b AND y.b=x.a) ORDER BY n DESC, a, b LIMIT 12")
register(
    "I11_relays", lambda t: g.relays(t.cdr),
    E + ", r AS (SELECT id, a_party_number AS a, b_party_number AS b, epoch_us(start_time)/1e6 AS t FROM cdr WHERE a_party_number<>b_party_number) SELECT a, b, c, round((m[2]-m[1])/60,3) AS minutes FROM (SELECT x.a, x.b, y.b AS c, min([x.t, y.t]) AS m FROM r x JOIN r y ON x.b=y.a AND y.t>x.t AND y.t-x.t<=900 AND y.b<>x.a GROUP BY 1,2,3) ORDER BY m[1], m[2], a, b, c LIMIT 30",
)
register(
    "I12_link_prediction", lambda t: g.link_prediction(_e(t)),
    E + """, ca AS (SELECT DISTINCT x.dst AS a, y.dst AS b FROM bw x JOIN bw y ON x.src=y.src AND x.dst<y.dst JOIN nd ON nd.node=x.src WHERE degree<=200 EXCEPT SELECT src, dst FROM bw), cm AS (SELECT ca.a, ca.b, count(*) AS common, sum(1/ln(degree)) AS aa, sum(1/degree) AS ra FROM ca JOIN bw x ON x.src=ca.a JOIN bw y ON y.src=ca.b AND y.dst=x.dst JOIN nd ON nd.node=x.dst GROUP BY 1,2)
 SELECT cm.a, cm.b, common, round(aa,6) AS adamic_adar, round(ra,6) AS resource, round(common/(p.degree+q.degree-common),6) AS jaccard FROM cm JOIN nd p ON p.node=cm.a JOIN nd q ON q.node=cm.b ORDER BY adamic_adar DESC, a, b LIMIT 10""",
)
register("I13_summary", lambda t: g.summary(_e(t)), E + "SELECT *, round(2*edges/(nodes*(nodes-1)),6) AS density FROM (SELECT count(*) AS nodes, round(avg(degree),3) AS avg_degree FROM nd), (SELECT count(*) AS edges, max(weight) AS strongest FROM ed)")
register("I14_roles", lambda t: g.roles(_e(t)))
register("I15_clustering", lambda t: g.clustering(_e(t)), TRI + "SELECT node, degree, CASE WHEN degree>1 THEN round(2*coalesce(t,0)/(degree*(degree-1)),6) ELSE 0 END AS clustering FROM nd LEFT JOIN (SELECT node, count(*) AS t FROM (SELECT unnest([a,b,c]) AS node FROM tri) GROUP BY 1) USING (node)")
register("I16_triads", lambda t: g.triads(_e(t)), TRI + "SELECT closed, CAST(touch-2*closed AS BIGINT) AS open, m*(n-2) AS total FROM (SELECT 3*count(*) AS closed FROM tri), (SELECT sum(p.degree+q.degree-2) AS touch, count(*) AS m FROM ed JOIN nd p ON p.node=src JOIN nd q ON q.node=dst), (SELECT count(*) AS n FROM nd)")
register("I17_core_numbers", lambda t: g.core_numbers(_e(t)))
register("I18_pagerank_unweighted", lambda t: g.pagerank(_e(t), rounds=50, weighted=False).withColumn("rank", F.round("rank", 6)))
register("I19_structural_roles", lambda t: g.structural_roles(_e(t)))
register("I20_calling_circles", lambda t: g.triangles(_e(t)).orderBy(F.desc("calls"), "a", "b", "c").limit(20), TRI + "SELECT a, b, c, CAST(calls AS BIGINT) AS calls FROM tri ORDER BY calls DESC, a, b, c LIMIT 20")
register("I21_reciprocity", lambda t: g.reciprocity(t.cdr), E + D + "SELECT count(*) AS directed, count(y.a) AS returned, round(count(y.a)/count(*),6) AS reciprocity FROM dp x LEFT JOIN dp y ON y.a=x.b AND y.b=x.a")
register("I22_components", lambda t: g.components(_e(t)))
register("K06_entities", lambda t: g.resolve_entities(t.cdr))
