"""Inputs of the legal operators, made from the driver's tables by SQL that both engines run alike."""

LEGAL = """select o_orderkey as id, o_custkey % 97 as case_no, concat('Appeal ', cast(o_orderkey as string), ' under Section ', cast(100 + o_custkey % 411 as string), ' of the Indian Penal Code read with section ', cast(1 + o_orderkey % 40 as string), '. See (', cast(year(o_orderdate) as string), ') ', cast(1 + o_orderkey % 9 as string), ' SCC ', cast(100 + o_orderkey % 900 as string), case o_orderkey % 5 when 0 then '. That decision stands overruled.' when 1 then '. It was distinguished.' when 2 then '. It was followed and approved.' when 3 then '. Ibid. The appeal is dismissed.' else '.' end) as txt, cast(year(o_orderdate) as int) as yr from orders"""
CHUNKS = """select o_orderkey as chunk_id, o_custkey % 97 as case_no, case o_orderkey % 4 when 0 then 'SUPREME COURT OF INDIA' when 1 then 'DELHI HIGH COURT' when 2 then 'BOMBAY HIGH COURT' else 'DISTRICT COURT, PUNE' end as court, case o_orderkey % 3 when 0 then 'ratio' when 1 then 'obiter' else 'facts' end as section_type, cast(year(o_orderdate) as int) as yr, o_orderpriority as priority, o_totalprice / 600000 as score from orders"""
EDGES = "select distinct o_custkey as src, o_orderkey % (o_custkey + 1) as dst from orders"

ASK = """select o_orderkey as id, case o_orderkey % 13 when 0 then concat('What is IPC ', cast(1 + o_custkey % 600 as string), '?') when 1 then concat('Explain section ', cast(1 + o_custkey % 600 as string), 'A of the BNS') when 2 then 'Compare the Indian Penal Code and the Bharatiya Nyaya Sanhita' when 3 then 'How do I apply for a passport?' when 4 then concat('u/s ', cast(1 + o_custkey % 90 as string), ' IPC: which cases decided it?') when 5 then concat('Does section ', cast(1 + o_custkey % 700 as string), ' of the CrPC matter?') when 6 then 'What does the Evidence Act say about a dying declaration?' when 7 then concat('Is it an offence under section ', cast(1 + o_custkey % 500 as string), '?') when 8 then concat('BNS ', cast(1 + o_custkey % 400 as string), ' and IPC section ', cast(1 + o_custkey % 300 as string)) when 9 then 'theft of a bicycle' when 10 then concat('NDPS section ', cast(20 + o_custkey % 9 as string), ' and POCSO') when 11 then 'penal code punishment for cheating, whether liable' else 'Nyaya Sanhita landmark judgment on murder' end as txt, case o_orderkey % 7 when 0 then 'ipc' when 1 then ' BNS ' when 2 then 'both' when 3 then 'other' else null end as override from orders"""
HELD = "select distinct case p_partkey % 2 when 0 then 'IPC' else 'BNS' end as statute, cast(p_partkey % 512 as string) as section from part"
ANSWERS = """select o_orderkey as id, case o_orderkey % 11 when 10 then '' when 9 then 'The retrieved legal sources do not contain sufficient information to answer this question.' else concat('Under section ', cast(100 + o_custkey % 7 as string), ' IPC ', case o_orderkey % 6 when 0 then 'imprisonment for a term up to ten years' when 1 then 'the punishment extends to seven years and fine of Rs. 5,000' when 2 then 'life imprisonment' when 3 then 'see (2010) 4 SCC 350' when 4 then 'see AIR 1973 SC 1461 and Ram Lal v. State Kumar' else 'the Indian Penal Code applies' end, '. ', case o_orderkey % 4 when 0 then 'Also [2018] 14 S.C.R. 828.' when 1 then '2023 INSC 590 is cited.' when 2 then 'The NDPS Act is not relevant.' else '' end) end as answer, concat('Section ', cast(100 + o_custkey % 5 as string), case o_custkey % 5 when 0 then ' may extend to seven years, and fine of rupees 5000' when 1 then ' ten years; imprisonment for life. AIR 1973 SC 1461' when 2 then ' in (2010) 4 SCC 350 Ram Lal and State Kumar met under the Indian Penal Code' when 3 then ' extended the tenor of the [2018] 14 S.C.R. 828 NDPS Act' else ' nothing here' end) as context from orders"""
HITS = "select o_custkey as query_id, o_orderkey as chunk_id, o_totalprice / 600000 as score, case o_orderkey % 5 when 0 then 'IPC' else 'BNS' end as law, cast(o_orderkey % 40 as string) as section from orders"
CHOICES = "select o_custkey as query_id, case o_custkey % 3 when 0 then 'IPC' when 1 then 'BNS' else null end as law, case o_custkey % 4 when 0 then cast(o_custkey % 40 as string) else null end as section from orders group by 1, 2, 3"
JUDGMENTS = """select o_orderkey as id, o_custkey % 97 as case_no, cast(year(o_orderdate) as int) as yr, case o_orderkey % 4 when 0 then 'SUPREME COURT OF INDIA' when 1 then 'HIGH COURT OF DELHI' when 2 then 'CONSUMER FORUM, NEW DELHI' else 'Court of Session. it was ARGUED' end as court, concat('Case ', cast(o_custkey % 97 as string), ' v. State') as title, case o_orderkey % 6 when 0 then 'KEY_POINTS' when 1 then 'reasoning' when 2 then 'ORDER' when 3 then 'FACTS' when 4 then 'REASONING' else 'ISSUES' end as section, case o_orderkey % 5 when 0 then concat('12 March ', cast(year(o_orderdate) as string)) when 1 then 'undated' when 2 then '' else cast(year(o_orderdate) as string) end as dated, concat('In Ram Kumar v. State Of Kerala (', cast(year(o_orderdate) as string), ')', cast(1 + o_orderkey % 9 as string), 'SCC', cast(100 + o_orderkey % 900 as string), ' at p. ', cast(1 + o_orderkey % 50 as string), chr(10), cast(1 + o_orderkey % 30 as string), '. The accused was convicted under Section ', cast(290 + o_orderkey % 20 as string), ' of the Indian Penal Code; see Para ', cast(o_orderkey % 70 as string), ' and [', cast(o_orderkey % 9 as string), '] AIR ', cast(year(o_orderdate) as string), ' SC ', cast(o_orderkey % 500 as string), '. ', case o_orderkey % 9 when 0 then 'It was held that the order is set aside.' when 1 then 'The appeal stands overruled; murder and bail.' when 2 then 'We hold the decision is approved under the Evidence Act.' when 3 then 'However the facts are different; NDPS and theft.' when 4 then 'Decided without noticing the doctrine of mens rea.' when 5 then 'Upheld. The duty and right to life, per incuriam.' when 6 then '[2001] 2 AC 17 and MANU/SC/12/1999; dying declaration under section 27 of the Evidence Act.' when 7 then 'The BNS and BNSS are new, ex parte, prima facie, therefore invalid.' else 'Nothing more.' end) as txt from orders"""
LAWS = """select p_partkey as ord, case p_partkey % 2 when 0 then 'IPC' else 'BNS' end as document, concat(cast(1 + p_partkey % 500 as string), case p_partkey % 7 when 0 then 'A' else '' end) as section, p_name as title, case p_partkey % 11 when 0 then '  ' when 1 then 'Rep. by Act 4 of 1898' else concat('Whoever does ', p_type, '; shall be punished. Explanation: ', p_brand, ' is meant.') end as txt from part"""

HEADERS = """select o_orderkey as id, concat(case o_orderkey % 7 when 0 then concat('IN THE HIGH COURT OF DELHI AT NEW DELHI', chr(10)) when 1 then concat('IN THE SUPREME COURT OF INDIA', chr(10)) when 2 then concat('BEFORE THE COURT OF SH. A K JAIN, DISTRICT JUDGE, PUNE', chr(10)) when 3 then 'PETITIONER: Ram Lal & Sons Vs. RESPONDENT: State of Bihar DATE OF JUDGMENT: 12/03/1999 ' when 4 then concat('IN THE matter ARGUED before this COURT', chr(10), 'SESSIONS COURT OF THE ADDITIONAL JUDGE', chr(10)) when 5 then concat('NATIONAL GREEN TRIBUNAL, PRINCIPAL BENCH', chr(10)) else concat('Gopal (Retd.) And Anr vs Union Of India And Ors on 4 March, 1999', chr(10)) end, case o_orderkey % 5 when 0 then concat('Criminal Appeal No. ', cast(1 + o_orderkey % 900 as string), ' of 1998') when 1 then concat('W.P. (C) No. ', cast(1 + o_orderkey % 70 as string), '/2011') when 2 then 'Case No: X' when 3 then concat('O.S. No. 7-', cast(o_custkey % 97 as string)) else 'no number' end, chr(10), case o_orderkey % 3 when 0 then 'Dated this the 3 March 2001' when 1 then concat('Judgment reserved on: 0', cast(1 + o_orderkey % 9 as string), '. 02 .2010') else '' end, chr(10), case o_orderkey % 4 when 0 then concat('Justice B. N. Rao', chr(10), 'Hon''ble Mr. Justice A. Sen') when 1 then 'JUSTICE X' when 2 then 'Mr. Justice Roy' else '' end) as header, concat('1. Facts. ', case o_orderkey % 6 when 0 then 'The appeal is dismissed.' when 1 then 'It is disposed of; the PETITION ALLOWED.' when 2 then 'Writ petition is allowed, heard on 05-06-2007.' else 'No outcome.' end) as body from orders"""
TITLES = """select o_orderkey as id, case o_orderkey % 9 when 0 then 'Ram Lal Through Sh. Mohan Singh Adv. vs State of Bihar' when 1 then 'Mr. A. K. Sharma, Advocate v. Union of India' when 2 then concat('Gopal S/o Ram R/o Delhi vs.', chr(10), ' M/s Acme Ltd. Registered Office Mumbai') when 3 then 'Sita Devi .... Petitioner v The State ...... Respondents' when 4 then concat('No parties here ', cast(o_custkey as string)) when 5 then 'Om Prakash, aged about 45 years VS Delhi Admin Represented by Counsel' when 6 then 'AB v. CD' when 7 then 'Acme Bank Ltd. Through its Manager v. Ravi Kumar, Sr. Counsel' else concat('Party ', cast(o_custkey % 97 as string), ' v. Other v. Third ... ') end as title from orders"""
PAGES = """select o_custkey % 97 as doc, o_orderkey as page, concat(case o_orderkey % 3 when 0 then concat('carried on ', cast(o_orderkey as string), '. More text', chr(10)) when 1 then chr(10) else '' end, case o_orderkey % 5 when 0 then concat('2. Brief Facts:', chr(10), 'He went home.', chr(10), 'ORDER', chr(10)) when 1 then concat('RATIO DECIDENDI -', chr(10), chr(10), 'We hold so.', chr(10), 'Facts', chr(10), 'again ', cast(o_orderkey % 11 as string)) when 2 then concat('JUDGMENT', chr(10), '   ', chr(10), 'HELD.', chr(10)) when 3 then 'The facts and the order in a line.' else '  ' end) as txt from orders"""

ACTS = """select p_partkey as ord, concat('Preamble text.', chr(10), 'CHAPTER I', chr(10), 'Of ', p_brand, chr(10), '1. ', p_name, '.--Whoever does ', p_type, ' shall be punished.', chr(10), '2.', chr(10), 'Next note', chr(10), 'Of things', chr(10), cast(2 + p_size % 3 as string), '. Second ', p_name, '.--Body two; see section 1.', chr(10), '1*[1. Subs. by Act 27 of 1870.--note', chr(10), case p_partkey % 4 when 0 then concat('CHAPTER II', chr(10), 'Of offences', chr(10)) when 1 then concat('OF MORE', chr(10)) else '' end, cast(4 + p_partkey % 9 as string), case p_partkey % 3 when 0 then 'A' else '' end, '. Third ', p_type, '. -- Rep. by Act 4 of 1898.', chr(10), '3. Back pointing.--ignored text', chr(10), '90. Added by Act 2.--not a section', chr(10), '99. Last.--End of ', p_name, chr(10), '100.') as txt from part"""
