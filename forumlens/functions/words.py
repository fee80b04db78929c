"""English defaults for text normalisation; both are parameters of every operator using them."""

# Frequent English function words.
STOP_WORDS = tuple("""
a about above after again against all also although always am among an and another any anyone anything are around as
at be because been before being below between both but by can cannot could did do does doing done down during each
either else even ever every few for from further had has have having he her here hers herself him himself his how
however i if in into is it its itself just least less many may me might mine more most much must my myself neither
never no nor not now of off often on once only or other our ours out over own per perhaps rather re same she should
since so some still such than that the their them then there these they this those through to together too toward
under until up upon us very via was we were what when where whether which while who whose why will with within
without would yet you your yours
""".split())

# Irregular and frequent regular forms with their dictionary form.
LEMMAS = dict(pair.split(":") for pair in """
are:be is:be was:be were:be been:be being:be am:be has:have had:have having:have does:do did:do done:do doing:do
says:say said:say goes:go went:go gone:go makes:make made:make making:make takes:take took:take taken:take
taking:take gets:get got:get gives:give gave:give given:give giving:give finds:find found:find finding:find
shows:show showed:show shown:show showing:show causes:cause caused:cause causing:cause uses:use used:use using:use
grows:grow grew:grow grown:grow growing:grow leads:lead led:lead leading:lead means:mean meant:mean keeps:keep
kept:keep becomes:become became:become becoming:become comes:come came:come coming:come sees:see saw:see seen:see
seeing:see knows:know knew:know known:know thinks:think thought:think studies:study studied:study studying:study
men:man women:woman children:child people:people mice:mouse feet:foot teeth:tooth lives:life leaves:leaf
wolves:wolf analyses:analysis crises:crisis species:species bacteria:bacterium viruses:virus vaccines:vaccine
brains:brain cells:cell genes:gene patients:patient scientists:scientist researchers:researcher results:result
risks:risk diseases:disease levels:level years:year better:good best:good worse:bad worst:bad
""".split())
