"""Term counts of whole licence files (from the licences' published texts, copyright lines left out)."""

COUNTS = {
    "Apache-2.0": (
        "1:2 2:1 2.0:2 2004:1 3:1 4:1 5:1 50:1 6:1 7:1 8:1 9:2 a:22 above:1 acceptance:1 accepting:3 act:1 "
        "acting:1 acts:1 add:2 addendum:1 additional:5 additions:1 advised:1 against:2 agree:1 agreed:3 "
        "agreement:1 all:3 alleging:1 alone:1 along:1 alongside:1 also:1 an:7 and:46 annotations:1 any:30 "
        "apache:4 appear:1 appendix:2 applicable:3 applies:1 apply:2 appropriate:1 appropriateness:1 "
        "archives:1 are:6 arising:1 as:17 asserted:1 associated:1 assume:1 at:2 attach:1 attached:1 "
        "attribution:4 authorized:2 authorship:3 available:1 b:1 based:1 basis:2 be:5 been:2 behalf:5 below:1 "
        "beneficial:1 bind:1 boilerplate:1 brackets:2 but:5 by:23 c:1 cannot:1 carry:1 cause:2 changed:1 "
        "character:1 charge:1 choose:1 claims:2 class:1 code:3 combination:1 comment:1 commercial:1 common:1 "
        "communication:3 compiled:1 compliance:1 complies:1 computer:1 conditions:13 configuration:1 "
        "consequential:1 consistent:1 conspicuously:1 constitutes:1 construed:1 contained:1 content:1 "
        "contents:1 contract:2 contribution:8 contributions:3 contributor:10 contributory:1 control:4 "
        "controlled:1 conversions:1 copies:1 copy:3 copyright:13 counterclaim:1 cross-claim:1 customary:1 d:1 "
        "damages:5 date:1 defend:1 defined:1 definition:2 definitions:1 deliberate:1 derivative:18 derived:1 "
        "describing:1 description:1 designated:1 determining:1 different:1 direct:3 direction:1 disclaimer:1 "
        "discussing:1 display:2 distribute:5 distributed:3 distribution:5 do:3 document:1 documentation:3 "
        "does:1 don:1 each:4 easier:1 editorial:1 either:2 elaborations:1 electronic:2 enclosed:2 end:1 "
        "entities:1 entity:10 even:1 event:1 example:1 except:3 excluding:3 executed:1 exercise:1 "
        "exercising:1 explicitly:1 express:2 failure:1 fee:1 fields:1 fifty:1 file:8 filed:1 files:3 "
        "fitness:1 following:3 for:24 form:13 format:1 from:5 generated:2 give:1 goodwill:1 governing:1 "
        "grant:3 granted:2 granting:1 grants:2 grossly:1 harmless:1 has:2 have:2 hereby:2 herein:1 hold:1 "
        "how:1 however:1 http:2 i:1 identification:1 identifying:1 if:6 ii:1 iii:1 implied:2 import:1 "
        "improving:1 in:24 inability:1 incidental:1 include:3 included:2 includes:1 including:9 inclusion:2 "
        "incorporated:2 incurred:1 indemnify:1 indemnity:1 indicated:1 indirect:2 individual:3 information:1 "
        "informational:1 infringed:1 infringement:1 institute:1 intentionally:2 interfaces:1 irrevocable:2 "
        "is:10 issue:1 its:3 january:1 kind:2 language:1 law:3 lawsuit:1 least:1 legal:5 liability:5 liable:1 "
        "licensable:1 license:34 license-2.0:1 licensed:1 licenses:3 licensor:10 limitation:2 limitations:1 "
        "limited:4 link:1 lists:1 litigation:2 loss:1 losses:1 made:2 mailing:1 make:1 making:1 malfunction:1 "
        "managed:1 management:1 marked:1 marks:1 may:9 mean:10 means:2 mechanical:1 media:1 medium:1 meet:1 "
        "merchantability:1 merely:1 modifications:6 modified:1 modify:2 modifying:1 more:1 must:4 name:3 "
        "names:2 necessarily:1 negligence:1 negligent:1 no:2 no-charge:2 non-exclusive:2 non-infringement:1 "
        "normally:1 not:12 nothing:1 notice:9 notices:8 notwithstanding:1 object:6 obligations:2 obtain:1 "
        "of:67 offer:2 on:11 one:1 only:4 or:69 origin:1 original:2 other:7 otherwise:6 out:1 outstanding:1 "
        "own:4 owner:6 ownership:2 page:1 part:4 particular:1 patent:7 percent:1 perform:1 permission:1 "
        "permissions:3 perpetual:2 pertain:2 places:1 possibility:1 power:1 preferred:1 prepare:1 printed:1 "
        "product:1 prominent:1 provide:1 provided:5 provides:2 publicly:2 purpose:3 purposes:4 readable:1 "
        "reason:1 reasonable:1 received:1 recipients:1 recommend:1 redistributing:2 redistribution:1 "
        "regarding:1 remain:1 replaced:1 represent:1 representatives:1 reproduce:2 reproducing:1 "
        "reproduction:4 required:4 responsibility:1 responsible:1 result:1 resulting:1 retain:1 revisions:1 "
        "rights:1 risks:1 royalty-free:2 s:3 same:1 section:1 sections:1 see:1 sell:2 sent:1 separable:1 "
        "separate:1 service:1 shall:15 shares:1 should:1 software:2 sole:1 solely:1 source:12 special:1 "
        "specific:1 state:1 stated:2 statement:1 stating:1 stoppage:1 subject:2 sublicense:1 submission:1 "
        "submit:1 submitted:4 subsequently:1 such:18 supersede:1 support:1 syntax:1 systems:2 t:1 terminate:1 "
        "terms:9 text:4 that:22 the:100 their:2 then:2 theory:1 thereof:4 third-party:2 this:17 those:3 "
        "through:1 title:1 to:40 tort:1 tracking:1 trade:1 trademark:1 trademarks:2 transfer:1 "
        "transformation:1 translation:1 types:1 under:9 union:1 unless:4 use:10 using:1 verbal:1 version:3 "
        "warranties:3 warranty:4 was:1 we:1 where:1 wherever:1 whether:4 which:2 while:1 whole:2 whom:1 "
        "with:11 within:8 without:5 work:34 works:19 worldwide:2 writing:4 written:1 www.apache.org:2 you:26 "
        "your:13 yyyy:1"
    ),
    "BSD-2-Clause": (
        "1:1 2:1 a:1 above:2 advised:1 all:1 and:9 any:4 are:3 arising:1 as:1 be:1 binary:2 business:1 but:2 "
        "by:1 c:1 california:1 caused:1 code:1 conditions:3 consequential:1 contract:1 contributors:2 "
        "copyright:3 damage:1 damages:1 data:1 direct:1 disclaimed:1 disclaimer:2 distribution:1 "
        "documentation:1 even:1 event:1 exemplary:1 express:1 fitness:1 following:3 for:2 form:1 forms:1 "
        "goods:1 however:1 if:1 implied:2 in:6 incidental:1 including:3 indirect:1 interruption:1 is:2 "
        "liability:2 liable:1 limited:2 list:2 loss:1 materials:1 merchantability:1 met:1 modification:1 "
        "must:2 negligence:1 no:1 not:2 notice:2 of:13 on:1 or:10 other:1 otherwise:1 out:1 particular:1 "
        "permitted:1 possibility:1 procurement:1 profits:1 provided:3 purpose:1 redistribution:1 "
        "redistributions:2 regents:3 reproduce:1 reserved:1 retain:1 rights:1 services:1 shall:1 software:2 "
        "source:2 special:1 strict:1 substitute:1 such:1 that:1 the:14 theory:1 this:4 to:2 tort:1 "
        "university:1 use:3 warranties:2 way:1 whether:1 with:2 without:1"
    ),
    "BSD-3-Clause": (
        "1:1 2:1 3:1 a:1 above:2 advised:1 all:1 and:9 any:4 are:3 arising:1 as:1 be:2 binary:2 business:1 "
        "but:2 by:1 caused:1 code:1 conditions:3 consequential:1 contract:1 contributors:3 copyright:2 "
        "damage:1 damages:1 data:1 derived:1 direct:1 disclaimed:1 disclaimer:2 distribution:1 "
        "documentation:1 endorse:1 even:1 event:1 exemplary:1 express:1 fitness:1 following:3 for:2 form:1 "
        "forms:1 from:1 goods:1 however:1 if:1 implied:2 in:6 incidental:1 including:3 indirect:1 "
        "interruption:1 is:2 its:1 liability:2 liable:1 limited:2 list:2 loss:1 materials:1 may:1 "
        "merchantability:1 met:1 modification:1 must:2 name:1 names:1 negligence:1 neither:1 no:1 nor:1 not:2 "
        "notice:2 of:13 on:1 or:11 other:1 otherwise:1 out:1 particular:1 permission:1 permitted:1 "
        "possibility:1 prior:1 procurement:1 products:1 profits:1 promote:1 provided:3 purpose:1 "
        "redistribution:1 redistributions:2 regents:2 reproduce:1 reserved:1 retain:1 rights:1 services:1 "
        "shall:1 software:3 source:2 special:1 specific:1 strict:1 substitute:1 such:1 that:1 the:15 theory:1 "
        "this:5 to:3 tort:1 university:1 use:3 used:1 warranties:2 way:1 whether:1 with:2 without:2 written:1"
    ),
    "CC0-1.0": (
        "1:1 1.0:1 11:1 1996:1 2:1 3:1 4:2 9:1 96:1 a:18 abandoned:1 abandons:1 absence:2 account:1 "
        "accuracy:1 acknowledges:1 action:4 adapt:1 addition:1 additional:1 advertising:2 affected:2 "
        "affirmer:17 affirms:1 against:1 all:5 amended:1 an:5 and:55 any:24 applicable:7 applied:1 apply:2 "
        "are:2 arising:1 as:7 as-is:2 assert:1 associated:2 associating:1 at:1 attorney-client:1 author:1 "
        "authorship:1 automatically:1 available:1 b:1 based:1 basis:1 be:6 below:2 benefit:1 build:1 but:2 "
        "by:10 c:1 can:1 cancellation:1 case:2 causes:3 cc0:7 certain:1 claims:4 clearing:1 code:1 "
        "commercial:3 commons:8 communicate:1 compensation:1 competition:1 concerning:1 confer:1 consents:1 "
        "consideration:1 contemplated:1 contrary:1 contravention:1 contribute:1 contributing:1 copies:2 "
        "copyright:11 corporation:1 corresponding:1 council:1 create:1 creative:7 creator:1 cultural:2 "
        "culture:1 current:2 d:1 damages:1 data:1 database:2 databases:1 date:1 deemed:1 defects:1 defined:1 "
        "depicted:1 detriment:1 directive:2 disclaimers:1 disclaims:3 discoverable:1 display:1 disrupt:1 "
        "dissemination:1 distribute:2 distribution:2 document:5 does:2 duration:2 duty:1 each:4 ec:1 effect:1 "
        "effective:1 efforts:1 either:1 elects:1 enjoyment:1 equitable:1 equivalent:1 errors:1 european:1 "
        "exclusive:2 exercise:2 existing:1 expectation:1 express:4 extensions:2 extent:5 extraction:1 "
        "fallback:1 fear:1 firm:1 fitness:1 following:1 for:18 form:1 free:1 freely:1 from:1 fully:2 "
        "further:2 future:5 gain:1 grants:1 greater:1 greatest:2 has:1 he:2 heirs:1 held:1 her:2 hereby:3 "
        "hereunder:2 his:2 i:4 ideal:1 ii:4 iii:3 image:1 implementation:1 implementations:1 implied:1 in:21 "
        "include:1 including:9 incorporate:1 ineffective:2 ineffectiveness:1 information:3 infringement:2 "
        "intended:1 intending:1 into:1 invalid:2 invalidate:1 invalidity:1 irrevocable:1 irrevocably:1 is:4 "
        "its:1 iv:3 judged:3 jurisdictions:1 kind:1 knowledge:1 known:1 large:1 latent:1 later:1 law:8 laws:1 "
        "legal:5 legally:2 liability:1 license:6 licensed:1 likeness:1 limitation:5 limitations:2 limited:1 "
        "made:1 makes:3 march:1 maximum:3 may:3 meaning:1 medium:2 member:1 merchantability:1 modify:1 "
        "moral:1 most:1 motivations:1 national:2 necessary:1 neighboring:1 no:4 non:4 not:10 now:1 number:2 "
        "obligation:1 obtaining:1 of:50 offers:1 on:4 or:45 original:2 other:7 others:1 otherwise:2 overtly:1 "
        "owner:3 owners:2 paragraph:1 parliament:1 part:3 partial:1 particular:1 party:1 patent:1 perform:1 "
        "performer:1 permanently:2 permissible:1 permissions:1 permitted:2 person:4 persons:1 pertaining:1 "
        "possible:1 present:1 preserved:1 privacy:1 production:1 promote:1 promotional:2 protected:1 "
        "protecting:2 protection:1 provide:1 provided:4 provides:1 public:4 publicity:1 publicly:1 purpose:8 "
        "purposes:5 quiet:1 reason:2 redistribute:1 regarding:1 regards:1 related:11 relationship:1 "
        "reliably:1 relinquish:1 remainder:1 remaining:1 representations:1 reproduce:1 reputation:1 "
        "required:1 rescission:1 respect:2 responsibility:2 resulting:1 retained:1 reuse:2 revocation:1 "
        "right:1 rights:22 royalty-free:1 s:11 scientific:2 services:1 shall:4 she:2 should:2 similar:1 so:1 "
        "statement:4 statutory:1 subject:2 sublicensable:1 subsequent:1 successor:1 successors:1 such:5 "
        "surrendered:1 surrenders:1 taking:1 termination:1 terms:1 territories:2 that:6 the:66 their:1 then:1 "
        "thereof:3 these:2 this:7 those:3 through:1 throughout:2 time:2 title:1 to:29 trademark:1 "
        "transferable:1 translate:1 treaty:3 unconditional:1 unconditionally:1 under:7 understands:1 unfair:1 "
        "universal:1 unknown:1 upon:2 use:7 v:1 version:1 vi:1 vii:1 voluntarily:1 waived:1 waiver:7 waives:1 "
        "warranties:3 was:1 well:1 whatsoever:3 whether:2 will:1 wish:1 with:4 without:7 work:26 works:5 "
        "world:2 worldwide:2"
    ),
    "GPL-2.0": (
        "0:1 02110-1301:2 1:7 10:1 11:1 12:1 1989:2 1991:2 2:8 3:1 4:1 5:1 51:2 6:1 69:1 7:1 8:1 9:1 a:57 "
        "above:6 absence:1 absolutely:1 accept:2 acceptance:1 access:2 accompanies:1 accompany:3 accord:1 "
        "achieve:1 act:2 actions:1 activities:1 add:2 addition:1 address:1 addressed:1 advised:1 "
        "aggregation:1 agreed:1 agreement:1 all:14 allegation:1 allowed:2 along:3 also:5 alter:1 "
        "alternative:1 among:1 an:9 and:72 announcement:3 another:2 any:38 anyone:1 anything:1 applicable:2 "
        "application:1 applications:1 applies:3 apply:6 appropriate:3 appropriately:1 april:1 are:13 "
        "arising:1 as:21 ask:2 associated:1 assume:1 at:8 attach:2 attempt:1 author:5 authors:2 "
        "automatically:2 avoid:1 away:1 b:3 balance:1 based:12 be:16 because:1 been:2 being:1 believed:1 "
        "below:1 best:1 binary:1 body:1 boston:2 both:1 brief:1 bring:1 but:7 by:28 c:8 called:1 can:8 "
        "cannot:2 carry:1 case:1 cause:3 certain:4 change:5 changed:1 changing:1 charge:5 choice:1 choose:1 "
        "circumstance:1 circumstances:1 claim:1 claims:2 clear:2 code:16 collective:1 comes:1 commands:3 "
        "commit:1 compelled:1 compilation:1 compiler:1 compilers:1 complete:3 compliance:2 component:1 "
        "components:1 concerns:1 conditions:13 consequence:3 consequential:1 consider:1 considered:1 "
        "consistent:1 conspicuously:1 constantly:1 constitute:1 contact:1 containing:1 contains:3 contents:1 "
        "contest:2 contradict:1 contrast:1 contributions:1 control:2 convey:1 coon:2 copies:8 copy:18 "
        "copying:4 copyright:14 copyrighted:2 correction:1 corresponding:3 cost:2 could:2 countries:3 "
        "counts:1 course:1 court:2 covered:3 customarily:2 damages:3 danger:1 data:2 date:1 decide:1 "
        "decision:1 defective:1 definition:1 deny:1 depends:1 derivative:3 derivatives:1 derived:2 "
        "designated:1 designed:2 detail:1 details:3 develop:1 differ:1 different:1 directly:1 disclaimer:2 "
        "disclaims:1 display:1 distinguishing:1 distribute:19 distributed:7 distributing:2 distribution:16 "
        "do:8 document:1 does:6 donor:1 each:8 effect:1 effectively:1 either:7 electronic:1 else:3 employer:1 "
        "end:1 enforcing:1 entire:2 entirely:2 equivalent:1 even:4 event:1 ever:1 every:1 everyone:4 "
        "example:2 except:2 exception:2 exceptions:1 exchange:1 excluded:1 excluding:1 exclusion:1 excuse:1 "
        "executable:7 exercise:2 explicit:1 expressed:1 expressly:1 extend:1 extent:1 failure:1 fee:3 fifth:2 "
        "file:2 files:3 finally:1 fitness:2 floor:2 follow:1 following:3 for:39 forbid:1 form:4 forming:1 "
        "found:1 foundation:10 franklin:2 free:27 freedom:4 from:10 full:2 further:1 general:15 generally:1 "
        "generous:1 geographical:1 get:3 give:4 given:1 gives:1 gnomovision:3 gnu:8 goals:1 granted:1 "
        "grants:1 gratis:1 greatest:1 guarantee:1 guided:1 hacker:1 has:2 have:11 having:1 he:1 held:1 here:1 "
        "hereby:1 herein:1 hereinafter:1 holder:4 holders:1 hope:1 how:3 however:3 hypothetical:1 idea:1 "
        "identifiable:1 if:32 implemented:1 implied:3 impose:2 imposed:1 in:29 inability:1 inaccurate:1 inc:3 "
        "incidental:1 include:1 included:1 including:4 incorporate:1 incorporates:1 incorporating:1 "
        "independent:2 indicate:1 indirectly:1 individually:1 induce:1 information:2 infringe:1 "
        "infringement:1 installation:1 instead:2 intact:1 integrity:1 intended:4 intent:2 interactive:4 "
        "interactively:1 interchange:2 interest:1 interface:1 interfaces:1 into:3 introduced:1 invalid:1 "
        "is:53 issues:1 it:39 items:1 its:7 itself:2 james:1 judgment:1 june:1 keep:1 kernel:1 kind:1 know:3 "
        "language:1 later:3 law:4 least:2 legal:1 lesser:2 liable:1 library:2 license:46 licensed:4 "
        "licensee:2 licensees:1 licenses:4 licensor:1 like:1 limitation:3 limited:3 line:2 linking:1 long:1 "
        "loss:1 losses:1 ma:2 machine-readable:2 made:4 mail:1 major:1 make:9 makes:1 making:2 many:1 may:17 "
        "means:3 medium:4 meet:1 menu:1 merchantability:2 mere:1 mode:1 modification:4 modifications:3 "
        "modified:4 modify:9 modifying:2 modules:1 more:3 most:4 mouse-clicks:1 must:9 name:3 names:1 "
        "necessary:2 need:2 new:6 no:8 noncommercial:1 normally:3 not:34 nothing:1 notice:6 notices:3 "
        "number:3 object:4 obligations:2 obtain:1 of:104 offer:5 offering:2 on:26 one:2 only:5 operate:1 "
        "operating:1 option:3 or:77 order:1 ordinary:1 original:4 other:18 others:1 otherwise:3 our:3 ours:1 "
        "out:1 output:2 outside:1 paper:1 part:4 particular:3 parties:7 parts:2 party:3 passed:1 passes:1 "
        "patent:5 patents:3 people:1 performance:1 performing:1 permission:3 permissions:1 permit:3 "
        "permitted:4 pertinent:1 physical:1 physically:1 pieces:1 place:2 placed:1 places:1 plus:2 pointer:1 "
        "portion:3 possibility:1 possible:1 practices:1 preamble:1 precise:1 preferred:1 present:1 "
        "preserving:1 president:1 prevent:1 price:1 print:3 problems:2 program:71 programmer:1 programs:6 "
        "prohibited:1 prominent:1 promoting:1 property:1 proprietary:3 protect:2 protecting:1 protection:2 "
        "prove:1 provide:2 provided:4 public:16 publish:3 published:3 purpose:4 quality:1 range:1 rather:1 "
        "reads:1 reason:1 reasonably:1 receive:4 received:4 receives:1 recipient:1 recipients:4 "
        "redistribute:6 redistribution:1 redistributors:1 refer:1 referring:1 refers:1 reflect:1 refrain:1 "
        "regardless:1 reliance:1 remain:1 rendered:1 repair:1 reputations:1 required:3 requirements:1 "
        "responsibilities:1 responsible:1 rest:1 restricted:2 restrictions:3 reuse:1 revised:1 right:2 "
        "rights:11 risk:1 royalty-free:1 run:1 running:3 runs:1 s:5 safest:1 same:2 sample:1 satisfy:2 say:1 "
        "saying:2 school:1 scope:2 scripts:1 section:9 sections:6 see:1 separate:2 service:1 servicing:1 "
        "share:2 sharing:1 she:1 short:1 should:5 show:8 sign:1 signature:1 signed:1 similar:1 "
        "simultaneously:1 since:1 so:8 software:35 sole:1 some:1 someone:1 something:1 sometimes:1 source:16 "
        "speak:1 special:2 specifies:1 specify:1 spirit:1 start:1 started:1 starts:1 stated:1 stating:1 "
        "status:1 steps:1 storage:1 street:2 subject:1 sublicense:2 subroutine:1 subsection:1 such:12 suits:1 "
        "sure:3 surrender:1 sustained:1 system:5 take:1 telling:1 term:1 terminate:1 terminated:1 terms:18 "
        "than:3 that:35 the:194 their:2 them:3 themselves:1 then:4 there:3 therefore:1 thereof:1 these:11 "
        "they:6 things:1 third:5 this:49 thoroughly:1 those:3 though:1 threatened:1 three:1 through:3 thus:4 "
        "time:3 to:108 too:2 transferring:1 translate:1 translated:1 translation:1 true:1 two:2 ty:2 type:2 "
        "under:19 understands:1 unenforceable:1 unless:2 up:1 usa:2 use:9 used:3 useful:2 user:1 users:2 "
        "using:1 valid:1 validity:1 verbatim:3 version:13 versions:2 vice:1 view:1 void:1 volume:1 w:3 want:5 "
        "warranties:1 warranty:13 way:3 we:9 welcome:1 what:5 whatever:1 when:7 where:1 whether:3 which:10 "
        "who:5 whole:7 whose:3 wide:1 will:8 willing:1 wish:3 with:17 without:4 work:24 works:5 would:2 "
        "write:3 writing:2 written:4 wrote:1 year:2 years:1 you:76 your:20 yoyodyne:1"
    ),
    "GPL-3.0": (
        "0:1 1:6 10:4 11:3 12:1 13:2 14:1 15:3 16:3 17:1 1996:1 2:6 20:1 2007:3 28:1 29:1 3:6 30:1 4:4 5:2 "
        "6:1 60:1 6b:1 6d:1 7:4 8:1 9:1 a:184 ability:1 about:1 above:3 absence:1 absolute:1 absolutely:1 "
        "abuse:1 accept:2 acceptance:4 access:6 accessible:1 accompanied:3 accompanies:1 accord:4 according:1 "
        "achieve:1 acknowledges:1 acquired:2 across:1 actions:1 activities:3 activity:1 actual:1 actually:1 "
        "adapt:1 add:4 added:3 additional:14 address:1 addressed:1 adopted:1 adversely:1 advised:1 affects:1 "
        "affero:3 affirmed:1 affirms:1 after:2 against:2 aggregate:3 agree:1 agreed:1 agreement:3 aim:1 "
        "all:21 alleging:1 allow:1 allowed:3 along:5 already:1 also:7 alternative:1 although:1 among:1 an:26 "
        "ancillary:1 and:98 anti-circumvention:1 any:50 anyone:4 anything:4 applicable:9 applications:1 "
        "applied:1 applies:2 apply:14 appropriate:8 appropriately:1 approximates:1 are:28 area:1 arise:1 "
        "arising:1 arrange:2 arrangement:3 article:1 as:38 asking:1 assert:1 assets:1 associated:1 assume:1 "
        "assumption:1 assumptions:2 assures:1 at:8 attach:2 attempt:1 attributed:1 attributions:1 author:4 "
        "authorization:1 authorized:1 authorizes:2 authorizing:1 authors:7 automatic:1 automatically:4 "
        "available:9 avoid:1 away:1 b:6 based:6 basic:1 be:29 because:1 been:6 behalf:1 being:2 believe:1 "
        "below:1 benefit:1 best:1 between:1 beyond:1 body:1 both:2 box:1 brief:1 business:1 but:16 by:43 c:8 "
        "called:3 can:13 cannot:3 carry:2 case:2 cases:2 cause:2 cease:1 certain:4 cessation:1 change:5 "
        "changed:1 changing:1 characterized:1 charge:8 choose:2 choosing:1 circumstances:1 circumvention:4 "
        "civil:1 claim:1 claims:4 class:1 clear:1 clearly:1 closely:1 code:34 collect:1 combination:1 "
        "combine:1 combined:2 comes:2 commands:3 commercial:1 commitment:2 common:1 communication:2 "
        "compilation:3 compilations:1 compiler:1 compliance:1 comply:1 component:5 computer:2 computers:1 "
        "concerning:1 concerns:1 conditioned:1 conditions:14 connection:4 consequence:3 consequential:1 "
        "consider:1 considered:1 consistent:2 conspicuously:1 constantly:1 constitutes:1 construed:1 "
        "consumer:3 contact:1 contain:1 containing:1 contains:2 content:1 contents:1 context:1 continue:2 "
        "continued:1 contractual:2 contradict:1 contrast:1 contributor:10 control:6 controlled:1 convenient:1 "
        "convey:26 conveyance:1 conveyed:3 conveying:15 conveys:2 copies:14 copy:25 copying:4 copyleft:1 "
        "copyright:29 copyright-like:1 copyrightable:1 copyrighted:1 correction:1 corresponding:23 cost:2 "
        "could:3 counterclaim:1 countries:1 country:3 course:1 court:1 courts:1 covenant:1 coverage:2 "
        "covered:41 criterion:1 cross-claim:1 cure:1 customarily:2 customer:1 d:3 damages:3 danger:1 data:3 "
        "date:1 days:2 december:1 decide:1 declining:1 deemed:1 defective:1 defenses:1 defined:1 definition:2 "
        "definitions:1 denied:1 denominated:1 deny:1 denying:1 deprive:1 designated:1 designed:6 detail:1 "
        "details:3 determining:1 develop:1 developers:3 development:1 devices:1 differ:1 different:4 "
        "differently:1 direction:1 directions:1 directly:2 disclaim:1 disclaimer:3 disclaiming:1 "
        "discriminatory:2 display:2 displayed:1 displays:2 distinguishing:1 distribute:5 distributed:1 "
        "distributing:1 distribution:5 do:16 document:3 documented:1 does:13 domains:2 doubtful:1 "
        "downstream:2 durable:2 dwelling:1 dynamically:1 e:2 each:10 earlier:2 effect:1 effected:1 "
        "effective:1 effectively:2 efforts:1 either:9 electronic:1 embodied:2 employer:1 enable:1 enables:1 "
        "end:1 enforce:2 enforcing:2 ensure:2 entered:1 entire:4 entirely:1 entity:2 equivalent:3 "
        "erroneously:1 essential:3 even:2 event:1 ever:1 every:1 everyone:2 exact:1 example:5 except:4 "
        "exceptions:2 excluded:1 excluding:1 exclusion:1 exclusively:2 excuse:1 executable:3 execute:1 "
        "executing:1 exercise:3 exercising:1 expected:1 expects:1 explains:1 explicitly:2 express:2 "
        "expressed:1 expressly:1 extend:2 extended:1 extensions:1 extent:6 f:1 facilities:2 fails:1 failure:1 "
        "fair:1 family:1 fashion:1 favor:1 feature:1 fee:4 file:2 files:4 finally:2 find:2 first:2 fitness:2 "
        "fixed:2 flow:1 follow:3 following:3 for:86 forbid:2 force:1 form:11 format:1 forms:1 found:1 "
        "foundation:6 free:18 freedom:8 freedoms:1 from:29 fsf.org:1 fulfilling:1 full:1 functioning:1 "
        "fundamentally:1 further:8 future:2 general:21 general-purpose:2 generally:1 generate:1 get:4 give:6 "
        "given:3 gives:1 giving:2 gnu:19 governed:3 gpl:7 grant:5 granted:7 grants:3 gratis:2 greatest:1 "
        "guarantee:1 gui:1 had:1 has:9 have:14 having:2 hereafter:1 holder:10 holders:2 hope:1 hosts:1 "
        "household:1 how:6 however:6 https:4 hypothetical:1 idea:1 identifiable:1 if:49 implement:1 "
        "implementation:2 implied:4 import:1 importing:1 impose:3 imposed:2 in:81 inability:1 inaccurate:1 "
        "inc:1 incidental:1 include:6 included:3 includes:4 including:8 inclusion:1 incompatible:1 "
        "incorporating:1 incorporation:1 indemnification:1 independent:1 indicate:1 indicating:1 individual:2 "
        "individuals:2 industrial:1 inform:1 information:8 infringe:2 infringed:3 infringement:3 initiate:1 "
        "inside:1 install:4 installation:4 installed:3 instead:1 intact:3 intended:1 intention:1 "
        "interaction:3 interactive:4 interchange:2 interest:2 interface:7 interfaces:3 interfered:1 "
        "interpretation:1 interpreter:1 intimate:1 into:5 invalidate:1 irrevocable:1 is:70 it:52 item:1 "
        "its:10 itself:1 june:1 keep:3 kernel:1 key:1 keys:1 kind:2 kinds:2 know:2 knowingly:2 knowledge:1 "
        "language:2 larger:1 later:5 law:10 laws:2 lawsuit:1 least:2 legal:11 lesser:1 liability:7 liable:2 "
        "libraries:3 library:3 license:102 licensed:3 licensee:1 licensees:2 licenses:9 licensing:1 "
        "licensors:4 like:1 likewise:1 limit:2 limitation:2 limited:2 limiting:3 line:2 link:1 linked:1 "
        "linking:1 list:2 litigation:1 local:2 long:3 loss:1 losses:1 machine-readable:1 made:2 mail:1 "
        "maintain:1 major:5 make:14 makes:1 making:8 manner:3 manufacturer:1 march:1 marked:2 marks:1 masks:1 "
        "material:13 materially:1 may:31 meaning:1 means:18 measure:1 measures:3 medium:6 meet:1 meets:1 "
        "menu:1 merchantability:2 mere:1 merging:1 met:1 methods:1 might:1 misrepresentation:1 mode:2 model:1 "
        "modification:6 modifications:3 modified:13 modifies:2 modify:12 modifying:2 more:7 moreover:1 most:5 "
        "must:14 name:3 names:2 nature:1 necessary:2 need:5 needed:3 neither:1 network:8 new:7 next:1 no:17 "
        "non-consumer:1 non-exclusive:1 non-exercise:1 non-free:1 non-permissive:3 non-source:2 "
        "noncommercially:1 nor:1 normal:1 normally:2 not:50 nothing:2 notice:8 notices:11 notifies:1 notify:1 "
        "notwithstanding:2 number:2 numbered:2 object:21 obligate:1 obligated:1 obligations:4 occasionally:1 "
        "occurring:1 occurs:2 of:221 offer:8 offered:1 offering:2 official:1 on:31 one:7 only:8 operate:1 "
        "operated:1 operating:1 operation:2 option:3 options:1 or:151 order:2 organization:2 organizations:2 "
        "origin:1 original:2 other:30 others:4 otherwise:6 our:2 out:1 output:3 outside:1 own:1 owned:1 "
        "packaged:1 packaging:1 paper:1 paragraph:2 paragraphs:1 part:10 particular:10 parties:8 parts:6 "
        "party:12 pass:1 password:1 patent:23 patents:6 pattern:1 payment:1 peer-to-peer:2 peers:1 "
        "performance:1 performing:2 permanently:4 permission:10 permissions:10 permissive:1 permit:3 "
        "permits:1 permitted:5 perpetuity:1 personal:2 pertinent:1 physical:6 physically:1 pieces:1 place:5 "
        "please:1 plus:1 pointer:1 portion:2 possesses:1 possession:3 possibility:1 possible:1 power:1 "
        "practical:1 practice:2 preamble:1 precise:1 precisely:1 predecessor:3 preferred:1 present:1 "
        "presents:1 preservation:1 prevent:2 prevented:1 previous:2 price:4 primarily:1 prior:3 private:1 "
        "problems:3 procedures:1 procuring:1 produce:2 product:21 products:3 program:52 programmer:1 "
        "programming:1 programs:6 prohibit:2 prohibiting:2 prohibits:1 prominent:3 prominently:1 propagate:9 "
        "propagating:1 propagation:4 property:1 proprietary:3 protect:3 protecting:2 protection:2 protocols:1 "
        "prove:1 provide:5 provided:13 provision:3 provisionally:1 proxy:2 public:25 publicity:1 publicly:2 "
        "publish:2 published:3 purpose:3 purposes:3 pursuant:1 qualify:1 quality:1 read:1 readily:1 reading:1 "
        "ready:1 reason:1 reasonable:6 receipt:1 receive:8 received:8 receives:3 receiving:1 recipient:5 "
        "recipients:7 recognized:1 redistribute:3 referring:1 refers:3 refrain:1 regard:1 regardless:5 "
        "regenerate:1 reinstated:3 relationship:1 released:2 relevant:2 relicensing:2 relying:2 remain:1 "
        "remains:3 removal:1 remove:2 render:1 rendered:1 repair:1 represent:1 require:5 required:4 "
        "requirement:5 requirements:5 requires:1 requiring:4 resolved:1 respect:2 responsibilities:2 "
        "responsible:1 restrict:1 restricting:1 restriction:3 restrictions:2 result:1 resulting:3 results:1 "
        "retains:1 return:1 reviewing:1 revised:2 right:3 rights:19 risk:1 rom:1 royalty:2 royalty-free:1 "
        "rules:1 run:8 running:3 runs:1 s:12 safest:1 sake:1 sale:2 same:5 satisfy:3 saying:1 school:1 "
        "scope:1 scripts:1 secondarily:1 section:15 sections:3 see:3 sell:1 selling:2 semiconductor:1 "
        "separable:1 separate:1 separately:3 server:5 serves:1 service:2 servicing:1 shall:5 share:2 shared:1 "
        "short:1 should:6 show:6 sign:1 significant:1 similar:2 simultaneously:1 single:2 so:11 software:27 "
        "sold:1 sole:1 solely:3 some:7 source:40 spare:1 speak:1 special:4 specific:3 specifically:3 "
        "specified:2 specifies:2 specify:1 spirit:1 stand:1 standard:3 standards:1 start:1 starts:1 state:1 "
        "stated:5 statement:2 states:1 stating:4 status:1 steps:1 storage:1 subdividing:1 subject:1 "
        "sublicenses:1 sublicensing:1 subprograms:2 subroutine:1 subsection:2 substantial:1 substantially:2 "
        "such:21 sue:1 suffice:1 supplement:2 support:3 supports:1 sure:3 surrender:2 survive:1 sustained:1 "
        "system:5 systematic:1 take:1 tangible:1 technological:3 tells:1 term:4 terminal:1 terminate:2 "
        "terminated:1 terminates:1 termination:2 terms:32 than:4 that:91 the:345 their:6 them:8 then:4 "
        "there:3 therefore:4 these:10 they:6 things:1 third:9 this:86 those:14 though:1 threatened:1 three:2 "
        "through:4 thus:2 time:4 to:190 too:2 tools:1 trade:1 trademark:1 trademarks:1 transaction:7 "
        "transfer:1 transferred:1 transferring:1 transmission:2 treated:1 treaty:1 two:1 type:2 typical:1 "
        "unacceptable:1 under:44 unless:5 unlimited:1 unmodified:3 unnecessary:1 unpacking:1 until:1 "
        "updates:1 use:24 used:12 useful:2 user:15 users:9 uses:3 using:4 valid:4 verbatim:3 version:25 "
        "versions:14 view:1 violates:1 violation:5 visible:1 void:1 volume:1 w:2 waive:1 waiver:1 want:3 "
        "warranties:2 warranty:15 was:1 way:7 ways:2 we:7 welcome:1 well:1 were:1 what:4 whatever:1 when:7 "
        "where:5 whether:5 which:21 who:8 whole:3 whom:1 whose:1 why-not-lgpl.html:1 widely:1 will:8 window:1 "
        "wipo:1 wish:2 with:45 within:2 without:7 work:97 working:1 works:12 worldwide:1 would:7 writing:2 "
        "written:4 www.gnu.org:3 year:2 years:1 you:128 your:34 yourself:1"
    ),
    "ISC": (
        "above:1 action:2 all:3 an:1 and:4 any:3 appear:1 arising:1 as:1 author:2 be:1 connection:1 "
        "consequential:1 contract:1 copies:1 copy:1 copyright:1 damages:2 data:1 direct:1 disclaims:1 "
        "distribute:1 event:1 fee:1 fitness:1 for:2 from:1 granted:1 hereby:1 implied:1 in:4 including:1 "
        "indirect:1 is:3 isc:1 liable:1 license:1 loss:1 merchantability:1 modify:1 negligence:1 no:1 "
        "notice:2 of:5 or:8 other:1 out:1 performance:1 permission:2 profits:1 provided:2 purpose:1 regard:1 "
        "resulting:1 shall:1 software:4 special:1 that:1 the:5 this:4 to:2 tortious:1 use:3 warranties:2 "
        "whatsoever:1 whether:1 with:3 without:1"
    ),
    "LGPL-2.1": (
        "0:1 02110-1301:2 1:8 10:1 11:1 12:1 13:1 14:1 15:1 16:1 1990:1 1991:1 1999:2 2:10 2.1:3 2d:1 3:1 4:1 "
        "5:1 51:2 6:5 6a:1 7:1 8:1 9:1 a:123 able:1 about:1 above:9 absence:1 accept:2 acceptance:1 access:4 "
        "accessors:1 accompanies:1 accompany:5 accompanying:1 achieve:1 act:2 actions:1 activities:1 add:2 "
        "addition:1 address:1 addressed:1 advantage:1 advantages:1 advised:1 affected:1 after:1 aggregation:1 "
        "agreed:1 agreement:2 all:16 allegation:1 allowed:2 along:3 already:3 also:10 alter:2 alternatively:1 "
        "although:1 among:2 an:12 and:91 another:2 any:39 anything:1 appeared:1 applicable:2 application:7 "
        "application-supplied:1 applies:5 apply:7 appropriate:1 appropriately:1 april:1 are:18 argument:1 "
        "arising:1 as:30 ask:2 associated:1 assume:1 at:7 attach:2 attempt:1 attention:1 author:4 "
        "authorized:1 authors:1 automatically:2 away:1 b:3 balance:1 based:16 be:29 because:3 becomes:1 "
        "been:2 being:2 believed:1 below:2 better:1 between:1 binary:1 body:2 boston:2 both:2 brief:1 bring:1 "
        "but:8 by:38 c:5 call:1 called:2 can:13 cannot:4 carefully:1 carry:1 case:4 cases:1 cause:2 certain:6 "
        "change:7 changed:1 changes:3 changing:1 charge:5 choice:2 choose:1 circumstance:1 circumstances:2 "
        "claim:1 claims:2 clear:2 close:1 code:23 collection:1 collective:1 combination:2 combine:1 "
        "combined:5 company:1 compelled:1 competing:1 compilation:1 compiled:1 compiler:1 complete:6 "
        "compliance:2 component:1 components:1 compute:2 computer:1 concerns:1 conditions:11 consequence:3 "
        "consequential:1 considered:1 consistent:2 conspicuously:1 constant:1 constitute:1 contact:1 "
        "containing:5 contains:5 contents:2 contest:2 contradict:1 contradiction:1 contradicts:1 contrast:1 "
        "contributions:1 control:2 conveniently:1 convey:1 coon:2 copies:9 copy:30 copying:5 copyright:14 "
        "copyrighted:2 correction:1 corresponding:2 cost:2 could:1 countries:3 counts:1 court:2 covered:6 "
        "creates:1 criteria:2 customarily:1 customer:1 d:2 damages:3 data:7 date:1 de-facto:1 debugging:1 "
        "decide:2 decision:1 defective:1 defined:1 definition:1 definitions:2 deny:1 depends:1 derivative:12 "
        "derivatives:1 derived:2 designated:4 designed:3 detail:1 details:1 develop:1 developers:1 differ:1 "
        "difference:1 different:1 directing:1 directly:2 disadvantages:1 disclaimer:2 disclaims:1 displays:1 "
        "distinguishing:1 distribute:23 distributed:9 distributing:2 distribution:17 distributor:1 "
        "distributors:1 do:11 document:1 does:10 donor:1 during:1 e:1 each:9 effectively:2 effort:1 either:7 "
        "electronic:1 else:2 employer:1 enables:2 encourage:1 end:1 enforcing:1 engineering:1 ensure:2 "
        "entire:3 entirely:3 equivalent:2 especially:1 even:4 event:2 ever:1 every:1 everyone:2 example:5 "
        "except:2 exception:2 exceptions:1 exchange:1 excluded:1 excluding:1 exclusion:1 excuse:1 "
        "executable:11 executables:4 execution:1 exercise:2 existence:1 explaining:1 explanations:1 "
        "explicit:1 expressed:1 expressly:1 extend:1 extent:1 facilities:4 facility:4 fact:1 failure:1 "
        "faith:1 fall:2 falls:1 february:1 fee:3 fifth:2 file:5 files:5 finally:1 find:1 first:2 fitness:2 "
        "fits:1 floor:2 follow:1 following:2 for:53 forbid:1 form:6 former:1 forming:1 found:1 foundation:9 "
        "franklin:2 free:29 freedom:9 frequent:1 frob:1 from:17 full:3 function:6 functions:4 further:1 "
        "gain:1 gave:1 general:27 generally:1 generous:1 geographical:1 get:3 give:5 given:3 gives:1 gnu:17 "
        "goals:1 good:1 gpl:1 granted:1 grants:1 gratis:1 greater:1 greatest:1 guarantee:1 guided:1 hacker:1 "
        "happen:1 has:7 have:10 he:1 header:1 held:1 hence:1 here:1 hereby:1 herein:1 hereinafter:1 holder:5 "
        "holders:1 hope:1 how:2 however:5 idea:1 identifiable:1 if:40 implemented:1 implied:3 impose:2 "
        "imposed:1 in:45 inability:1 inaccurate:1 inc:3 incidental:1 include:3 included:1 including:5 "
        "incompatible:1 incorporate:1 incorporates:1 independent:3 indicate:1 indirectly:1 induce:1 "
        "information:1 informed:1 infringe:1 infringement:1 inline:1 insist:1 installation:1 installs:1 "
        "instead:3 intact:1 integrity:1 intended:4 intent:2 interchange:1 interest:1 interface:1 "
        "interface-compatible:1 interfaces:1 into:5 introduced:1 invalid:1 invoked:1 irreversible:1 is:79 "
        "isolation:1 issues:1 it:50 its:10 itself:4 james:1 job:1 judgment:1 keep:1 kernel:1 kind:1 knobs:1 "
        "know:2 language:1 large:1 later:3 latter:1 law:5 lax:1 layouts:1 least:2 legal:1 legally:2 length:1 "
        "less:4 lesser:15 liable:1 libraries:9 library:140 license:76 licensed:2 licensee:2 licensees:1 "
        "licenses:4 licensor:1 limitation:3 limited:3 limiting:1 line:2 lines:1 link:5 linked:7 linking:5 "
        "linux:1 little:1 long:2 loss:1 losses:1 ma:2 machine-readable:3 macros:1 made:6 mail:1 major:1 "
        "make:10 making:3 many:3 material:1 materials:4 may:21 meaningful:1 means:5 mechanism:2 medium:3 "
        "meet:1 merchantability:2 mere:1 method:1 might:1 modification:5 modifications:4 modified:11 "
        "modify:10 modifying:2 modules:1 more:5 most:3 must:23 name:2 names:1 necessarily:1 necessary:2 "
        "need:3 needed:1 new:6 newer:1 no:7 non-free:6 normally:2 not:41 nothing:1 notice:6 notices:6 "
        "number:5 numerical:1 object:10 obligations:2 obtained:1 obtaining:1 occasions:1 of:160 offer:4 "
        "offering:3 on:30 once:1 one:4 only:6 operate:2 operates:1 operating:4 opt:1 option:4 optional:1 "
        "or:80 order:3 ordinary:11 original:5 other:26 others:1 otherwise:5 our:3 out:1 output:1 outside:2 "
        "over:1 own:1 packages:1 paper:1 parameters:1 part:6 particular:5 parties:7 parts:1 party:3 passed:2 "
        "patent:5 patents:3 pay:1 people:3 performance:1 performing:1 performs:1 permission:5 permissions:1 "
        "permit:3 permits:2 permitted:5 permitting:1 pertinent:1 physical:1 pieces:1 place:5 placed:1 "
        "places:1 plus:3 pointer:1 portion:5 portions:3 pose:1 possibility:1 possible:2 practices:1 "
        "preamble:1 precise:1 precisely:1 preferred:1 prepared:1 present:2 preserving:1 president:1 price:1 "
        "problems:2 produce:2 program:12 programmer:1 programs:9 prohibited:1 prominent:3 promoting:1 "
        "properly:1 property:1 proprietary:1 protect:4 protecting:1 protection:1 protective:1 prove:1 "
        "provide:2 provided:7 provides:2 public:29 publish:2 published:3 purpose:6 quality:1 quite:1 random:1 "
        "range:1 rare:1 rather:3 reason:2 reasonably:1 receive:4 received:3 receives:1 recipient:1 "
        "recipients:4 recommend:1 recompile:1 recompiling:1 redistribute:4 redistribution:2 refer:3 "
        "reference:1 referring:1 refers:2 refrain:1 regardless:2 released:1 reliance:1 relink:2 remain:1 "
        "remains:1 rendered:1 repair:1 reproducing:1 reputation:1 required:3 requirement:2 requirements:1 "
        "requires:1 responsibilities:1 responsible:1 rest:1 restrict:1 restricted:2 restrictions:4 "
        "restrictive:1 reuse:1 reverse:1 revised:1 right:2 rights:11 risk:1 root:1 roots:2 royalty-free:1 "
        "run:3 running:1 runs:1 s:7 safest:1 same:7 sample:1 satisfies:1 satisfy:2 say:1 saying:1 school:1 "
        "scope:3 scripts:1 section:13 sections:8 see:1 sent:1 separate:3 service:1 servicing:1 share:2 "
        "shared:2 sharing:1 she:1 should:5 show:1 side-by-side:1 sign:1 signature:1 signed:1 significant:1 "
        "similar:1 simultaneously:1 since:1 single:1 small:2 so:15 software:35 sole:1 some:3 someone:1 "
        "sometimes:1 source:15 speak:1 speaking:1 special:4 specially:1 specified:3 specifies:1 specify:2 "
        "spirit:1 square:3 standard:1 start:1 stated:1 states:1 statically:1 stating:1 status:1 still:3 "
        "storage:1 straightforwardly:1 strategy:1 street:2 structure:1 subject:1 sublicense:2 subsection:2 "
        "subsequent:1 successor:1 such:17 suggest:1 suitable:2 supplied:1 supply:3 sure:4 surrender:1 "
        "sustained:1 system:9 table:3 take:1 ten:1 term:1 terminate:1 terminated:1 terms:26 than:7 that:79 "
        "the:349 their:2 them:6 themselves:1 then:8 there:5 therefore:6 these:19 they:8 things:3 think:1 "
        "third:4 this:67 thoroughly:1 those:5 though:2 threat:1 three:1 threshold:1 through:3 thus:4 time:4 "
        "to:140 together:2 too:2 tool:1 transferring:1 translate:1 translated:1 translation:1 true:3 "
        "tweaking:1 two:3 two-step:1 ty:2 typically:1 uncombined:2 under:24 understood:1 unenforceable:1 "
        "unless:2 unrestricted:1 up:1 usa:2 use:27 used:6 useful:2 user:10 users:3 uses:13 using:3 utility:1 "
        "valid:1 validity:1 variant:1 verbatim:3 verify:1 version:25 versions:2 very:1 vice:1 void:1 volume:1 "
        "want:3 warranties:1 warranty:10 was:1 way:1 we:17 well:2 well-defined:1 were:1 what:5 whatever:2 "
        "when:8 where:2 whereas:1 wherewithal:1 whether:8 which:11 who:7 whole:7 whose:2 wide:1 widely:1 "
        "widest:1 will:10 willing:1 wish:5 with:42 without:5 work:58 works:6 would:2 write:3 writing:3 "
        "written:4 wrote:1 year:1 years:1 you:88 your:15 yoyodyne:1"
    ),
    "LGPL-3.0": (
        "0:2 1:2 2:1 2007:2 29:1 3:8 4:2 4d0:1 4d1:1 5:1 6:4 a:44 acceptance:1 accessors:1 accompany:4 "
        "accompanying:1 additional:3 address:1 allowed:1 already:1 also:2 among:1 an:9 and:30 any:8 "
        "applicable:1 application:14 applications:1 applies:1 apply:1 are:6 argument:1 as:8 at:1 "
        "authorization:1 b:5 based:5 be:3 being:1 below:2 both:2 bound:1 but:5 by:17 c:2 called:1 can:1 "
        "certain:1 changing:1 choice:3 choose:2 class:1 code:11 combined:21 combining:1 computer:1 concerns:1 "
        "conditions:2 considered:1 contained:1 convey:6 conveyed:1 conveying:3 copies:2 copy:10 copyright:3 "
        "corresponding:9 covered:5 d:1 data:4 debugging:1 decide:1 deemed:1 defined:2 defining:1 "
        "definitions:1 detail:1 differ:1 directing:1 displays:1 distinguishing:1 distribute:1 do:5 document:4 "
        "does:2 during:1 e:1 each:4 effectively:1 effort:1 either:1 engineering:1 ensure:1 event:1 ever:1 "
        "everyone:1 exception:1 excluding:2 execute:1 execution:1 explaining:1 extent:1 facilities:3 "
        "facility:4 faith:1 fewer:1 file:1 files:1 find:1 following:5 for:15 form:3 foundation:4 free:4 "
        "from:4 fsf.org:1 function:2 functions:1 future:1 general:11 give:3 given:1 gnu:21 good:1 governed:1 "
        "gpl:10 have:1 header:2 herein:1 https:1 if:10 in:13 inc:1 include:1 including:1 incorporate:1 "
        "incorporated:1 incorporates:1 incorporating:1 information:5 inline:1 install:1 installation:3 "
        "interface:2 interface-compatible:1 invoked:1 is:18 isolation:1 it:8 its:3 june:1 later:2 layouts:1 "
        "length:1 lesser:9 libraries:2 library:34 license:25 limited:1 lines:1 linked:5 linking:2 listed:1 "
        "macros:1 made:1 make:1 makes:1 manner:2 material:3 may:9 meaningful:1 means:2 mechanism:2 minimal:3 "
        "mode:1 modification:1 modifications:2 modified:7 modify:1 must:2 necessary:1 needed:1 new:3 none:1 "
        "not:9 notice:4 notices:2 number:2 numbered:1 numerical:1 object:6 of:60 on:7 one:2 only:2 operate:1 "
        "operates:1 option:3 or:14 other:4 otherwise:2 parameters:1 part:3 particular:1 passed:1 performs:1 "
        "permanent:1 permissions:2 permit:1 permitted:1 place:1 portions:2 present:2 problems:1 produce:1 "
        "produced:2 programs:1 prominent:3 properly:1 provide:3 provided:4 proxy:2 public:12 publish:1 "
        "published:3 purpose:1 received:3 recombine:1 recombining:1 reference:1 refers:4 relink:1 relinking:1 "
        "remains:1 reproducing:1 required:1 restrict:1 reverse:1 revised:2 run:1 s:2 same:2 section:5 "
        "sections:1 shall:1 shared:1 side:2 similar:1 single:1 small:1 software:4 source:8 specified:2 "
        "specifies:2 specify:1 spirit:1 statement:1 still:1 structure:1 subclass:1 such:6 suitable:3 "
        "supplemented:1 supplied:1 supply:1 system:2 taken:1 templates:1 ten:1 terms:8 than:2 that:26 the:114 "
        "then:1 these:1 this:15 time:3 to:22 together:2 uncombined:2 under:10 use:6 used:3 user:3 uses:2 "
        "using:1 utility:1 verbatim:1 version:27 versions:5 was:1 well:1 whatever:1 when:1 where:1 whether:1 "
        "which:2 will:2 with:16 without:1 work:24 works:1 would:1 you:20 your:4"
    ),
    "MIT": (
        "a:2 above:1 action:1 all:1 an:1 and:5 any:3 arising:1 as:1 associated:1 authors:1 be:2 but:1 "
        "charge:1 claim:1 conditions:1 connection:1 contract:1 copies:2 copy:2 copyright:2 damages:1 deal:1 "
        "dealings:1 distribute:1 do:1 documentation:1 event:1 express:1 files:1 fitness:1 following:1 for:2 "
        "free:1 from:1 furnished:1 granted:1 hereby:1 holders:1 implied:1 in:6 included:1 including:2 is:4 "
        "kind:1 liability:1 liable:1 license:1 limitation:1 limited:1 merchantability:1 merge:1 mit:2 "
        "modify:1 no:1 noninfringement:1 not:1 notice:2 obtaining:1 of:8 or:9 other:2 otherwise:1 out:1 "
        "particular:1 permission:2 permit:1 person:1 persons:1 portions:1 provided:1 publish:1 purpose:1 "
        "restriction:1 rights:1 sell:1 shall:2 so:1 software:9 subject:1 sublicense:1 substantial:1 the:15 "
        "this:2 to:8 tort:1 use:2 warranties:1 warranty:1 whether:1 whom:1 with:1 without:3"
    ),
    "MPL-2.0": (
        "1:1 1.1:2 1.10:1 1.11:1 1.12:1 1.13:1 1.14:1 1.2:1 1.3:1 1.4:1 1.5:1 1.6:1 1.7:1 1.8:1 1.9:1 10:1 "
        "10.1:1 10.2:2 10.3:2 10.4:1 2:2 2.0:5 2.1:6 2.2:1 2.3:1 2.4:1 2.5:1 2.6:1 2.7:1 3:1 3.0:1 3.1:3 "
        "3.2:2 3.3:3 3.4:3 3.5:1 30:1 4:1 5:1 5.1:2 5.2:2 5.3:1 50:1 6:1 60:1 7:1 8:1 9:1 a:55 ability:1 "
        "able:1 above:3 absence:1 absolutely:1 accurate:1 actions:1 add:1 addition:1 additional:5 "
        "additionally:1 affect:1 affero:1 after:2 against:3 agree:1 agreement:1 agreements:1 all:7 alleging:1 "
        "allow:1 alone:1 also:3 alter:4 an:7 and:36 any:44 anyone:1 apparatus:1 applicable:2 application:1 "
        "apply:2 are:5 as:12 asserting:1 assume:1 at:4 attached:3 attempt:2 authorized:1 automatically:1 "
        "available:3 b:12 back:1 basis:4 be:18 become:3 been:2 behalf:2 believes:1 beneficial:1 bring:1 "
        "brought:1 business:1 but:2 by:26 c:1 can:3 case:1 cause:1 caused:1 character:1 charge:2 choice:2 "
        "choose:2 circumstances:1 claim:2 claims:4 clear:1 code:21 combination:3 combines:1 come:1 "
        "commercial:1 common:1 complete:1 compliance:1 compliant:2 comply:6 computer:1 concerning:1 "
        "conditions:3 conflict-of-law:1 consequential:2 constitutes:1 construe:1 construed:1 contained:1 "
        "contains:1 contents:1 contract:3 contribute:1 contributes:1 contribution:5 contributions:8 "
        "contributor:35 contributors:1 control:2 controlled:1 controls:1 conveyed:2 copy:3 copyright:3 "
        "correction:1 cost:2 counter-claims:2 courts:1 covered:36 create:5 creates:1 creation:2 "
        "cross-claims:2 damages:5 date:2 days:2 dealing:1 death:1 declaratory:1 defective:1 defects:1 "
        "defendant:1 defined:1 definition:1 definitions:1 deletion:1 describe:1 described:3 description:2 "
        "desirable:1 detailed:1 different:1 differs:1 direct:2 direction:1 directly:1 directory:1 "
        "disclaimer:3 disclaimers:2 display:1 distinguishing:1 distribute:9 distributed:1 distributes:2 "
        "distributing:1 distribution:6 distributions:1 distributors:2 do:2 doctrines:1 document:1 does:2 "
        "drafter:1 due:2 each:6 earlier:1 effect:1 effective:2 either:6 end:1 enforceable:1 entire:1 "
        "entities:1 entity:6 equivalents:1 essential:1 even:1 event:1 every:1 except:7 excluding:2 "
        "exclusion:2 executable:7 exercising:1 exhibit:5 explicitly:1 exploit:1 expressed:1 extent:6 "
        "factual:1 fail:1 fails:1 failure:1 fair:3 fee:1 fifty:1 file:7 files:1 finally:1 first:2 fit:1 "
        "following:1 for:22 form:29 foundation:1 free:1 from:9 further:1 general:3 given:1 gnu:3 goodwill:1 "
        "governed:4 grant:6 granted:9 grants:6 has:5 have:6 having:2 held:1 hereby:2 hereof:1 how:2 however:2 "
        "http:1 i:1 if:17 ii:1 implied:2 import:2 impossible:1 in:30 inability:1 inaccuracies:1 incidental:2 "
        "include:2 included:1 includes:1 including:7 incompatible:6 incurred:1 indemnify:1 indemnity:3 "
        "indirect:2 indirectly:1 individual:2 inform:2 informed:1 infringed:2 infringement:1 infringements:1 "
        "infringes:1 initial:3 initiate:1 injury:1 intellectual:1 intended:1 into:1 is:23 it:7 its:14 "
        "judgment:1 judicial:1 jurisdiction:3 jurisdictions:1 kind:1 known:1 language:1 larger:6 later:1 "
        "law:2 laws:1 legal:4 lesser:1 liability:9 liable:1 licensable:3 license:69 licenses:13 licensing:1 "
        "likely:1 limit:2 limitation:8 limitations:4 litigation:4 location:1 logos:1 look:1 loss:1 losses:1 "
        "lost:1 made:4 maintains:1 make:4 makes:1 making:2 malfunction:1 management:1 manner:1 marks:1 "
        "material:1 matter:1 maximum:2 may:16 means:18 merchantable:1 method:1 miscellaneous:1 modification:1 "
        "modifications:6 modified:3 modify:2 more:4 moreover:1 mozilla:4 mozilla.org:1 mpl:2 must:9 name:1 "
        "necessary:3 negligence:2 new:5 no:8 non-compliance:3 non-exclusive:1 non-infringing:1 not:17 note:1 "
        "nothing:1 notice:11 notices:6 notifies:1 notify:1 notwithstanding:1 number:1 obligation:1 "
        "obligations:1 obtain:3 of:114 offer:3 offered:1 offering:1 on:8 one:4 ongoing:2 only:4 option:1 "
        "or:67 order:1 ordinary:1 original:1 originally:1 other:8 others:1 otherwise:4 outstanding:1 own:1 "
        "ownership:3 owns:1 part:3 particular:6 party:4 patent:10 percent:1 perform:1 performance:1 permits:1 "
        "permitted:2 personal:1 place:1 placed:1 portions:1 possibility:1 possible:3 power:1 preferred:1 "
        "prevent:1 principal:1 prior:3 process:1 profits:1 prohibited:1 prohibits:1 property:1 prove:1 "
        "provided:4 provides:1 provision:2 provisionally:1 provisions:1 public:6 publish:1 published:1 "
        "purpose:1 purposes:1 put:1 quality:1 reasonable:3 receipt:1 received:2 recipient:4 recipients:5 "
        "reference:1 references:1 reformed:1 regulation:4 reinstated:2 relating:1 relevant:1 remedy:1 "
        "remove:2 removed:1 rename:1 repair:1 representation:1 represents:2 reproduce:1 required:1 "
        "requirements:2 resellers:1 respect:3 responsibilities:1 restrict:1 result:2 resulting:1 results:1 "
        "right:2 rights:14 risk:1 royalty-free:1 s:8 sale:2 scope:1 secondary:12 section:11 sections:2 see:1 "
        "sell:1 selling:1 separate:1 service:1 servicing:1 shall:10 shares:1 should:1 skill:1 so:3 "
        "software:39 some:4 source:20 special:1 specific:1 statute:3 statutory:1 steward:4 stoppage:1 "
        "subject:2 sublicense:1 subsequent:3 subsequently:1 substance:1 such:32 sufficient:1 sufficiently:1 "
        "support:3 survive:1 terminate:2 terminates:1 termination:4 terms:20 text:1 than:5 that:26 the:130 "
        "their:1 then:5 theory:1 thereof:1 they:3 third:1 this:49 those:1 time:2 timely:1 to:62 tort:1 "
        "trademark:1 trademarks:1 transfer:2 under:35 understand:1 unenforceable:1 unless:1 unmodified:1 "
        "until:1 use:6 used:2 user:1 using:1 v:2 validly:1 version:17 versions:6 want:1 warranties:1 "
        "warranty:8 was:2 where:2 whether:3 which:5 who:1 will:3 with:22 within:1 without:5 work:11 "
        "world-wide:1 would:2 you:50 your:9"
    ),
}
